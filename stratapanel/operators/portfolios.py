"""Portfolios under constraints of size and industry, holdings with a buffer, and combinations of factors that are unlike each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cs
from ..functions.ts import SYM, T
from .evaluation import FWD, on_grid

# The plans.  s0: the best names; s05: the same, weighted to the market's industries; m1: the best without size; s1: the best of
# each industry; s2: the best of each industry without size and industry; s3: s2 with bounded weights.
PLANS = ("s0", "s05", "m1", "s1", "s2", "s3")


def _first(score: Column, n: Column, *more: str) -> Column:
    return F.when(score.isNotNull(), F.row_number().over(cs.section(*more).orderBy(score.desc_nulls_last(), F.col(SYM))) <= n)


def _pool(rows: DataFrame, top: float, least_hold: int, least: int, step: int) -> DataFrame:
    """Names that can be chosen at each rebalancing date, with scores and market weights (columns f, r, cap, industry are read)."""
    pool = on_grid(rows, step).where("f is not null and r is not null").withColumn("n", F.count("*").over(cs.section())).where(F.col("n") >= least)
    size = F.when(F.col("cap") > 0, F.col("cap")).otherwise(0.0)
    total = F.sum(size).over(cs.section())
    lncap = F.when(F.col("cap") > 0, F.log("cap"))
    pool = pool.withColumns(
        {
            "g": F.coalesce(F.col("industry").cast("int"), F.lit(-1)), "w_cap": F.when(total > 0, size / total).otherwise(1 / F.col("n")),
            "z": F.coalesce(lncap, F.avg(lncap).over(cs.section())),
        }
    )
    pool = pool.withColumns(
        {
            "n_hold": F.greatest(F.floor(F.col("n") * top), F.lit(least_hold)), "m": cs.residual_one(F.col("f"), F.col("z")),
            "fg": cs.cs_demean(F.col("f"), "g"), "zg": cs.cs_demean(F.col("z"), "g"),
        }
    )
    share = F.sum("w_cap").over(cs.section("g"))
    return pool.withColumns(
        {
            "quota": F.when(F.col("g") >= 0, F.bround(F.col("n_hold") * share)).otherwise(0),
            "both": cs.residual_one(F.col("fg"), F.col("zg")), "size_pct": cs.cs_rank(F.col("cap")),
        }
    )


def holdings(
    rows: DataFrame, top: float = 0.1, least_hold: int = 20, least: int = 100, max_w: float = 0.05, step: int = FWD,
) -> tuple[DataFrame, DataFrame]:
    """The names and weights of every plan, ``(plan, sym, t, w, s0, ...)``, and the pool they are chosen from."""
    pool = _pool(rows, top, least_hold, least, step)
    pool = pool.withColumns(
        {
            "p0": _first(F.col("f"), F.col("n_hold")), "pm": _first(F.col("m"), F.col("n_hold")),
            "q1": _first(F.col("f"), F.col("quota"), "g"), "q2": _first(F.col("both"), F.col("quota"), "g"),
        }
    )
    pool = pool.withColumns({"f1": F.when(F.col("q1"), F.col("f")), "f2": F.when(F.col("q2"), F.col("both"))})
    pool = pool.withColumns({"p1": _first(F.col("f1"), F.col("n_hold")), "p2": _first(F.col("f2"), F.col("n_hold"))})
    known = F.col("g") >= 0
    mine = F.sum(F.when(F.col("p0") & known, 1.0)).over(cs.section("g")) / F.sum(F.when(F.col("p0") & known, 1.0)).over(cs.section())
    theirs = F.sum(F.when(known, F.col("w_cap"))).over(cs.section("g")) / F.sum(F.when(known, F.col("w_cap"))).over(cs.section())
    pool = pool.withColumn("scale", F.when(F.col("p0") & known, F.try_divide(theirs, mine)))
    even = lambda c: F.when(F.col(c), 1 / F.sum(F.when(F.col(c), 1.0)).over(cs.section()))
    pool = pool.withColumns(
        {
            "w0": even("p0"),
            "w05": F.when(F.col("p0"), F.coalesce(F.try_divide(F.col("scale"), F.sum("scale").over(cs.section())), F.lit(0.0))),
            "wm": even("pm"), "w1": even("p1"), "w2": even("p2"),
        }
    )
    bound = F.when(F.col("w2").isNotNull(), F.least(F.col("w2"), F.lit(max_w)))
    pool = pool.withColumn("w3", bound / F.sum(bound).over(cs.section()))
    weights = F.array(
        *[F.struct(F.lit(p).alias("plan"), F.col(c).alias("w")) for p, c in zip(PLANS, ("w0", "w05", "wm", "w1", "w2", "w3"), strict=True)]
    )
    held = pool.withColumn("x", F.explode(F.filter(weights, lambda x: x["w"].isNotNull())))
    return held.select(
        F.col("x.plan").alias("plan"), SYM, T, F.col("x.w").alias("w"), "r", "g", "size_pct", F.coalesce("p0", F.lit(False)).alias("s0"),
    ), pool


def plan_periods(held: DataFrame, pool: DataFrame, cost: float = 0.002) -> DataFrame:
    """Per plan and date: names, turnover against the plan's last date, gross and net return, the even and the weighted market's,
    the mean size rank, the largest industry deviation, and the share of names that ``s0`` holds too."""
    base = held.groupBy("plan", T).agg(
        F.count("*").alias("names"), F.sum(F.col("w") * F.col("r")).alias("gross"), F.avg("size_pct").alias("size_pct"),
        F.avg(F.col("s0").cast("double")).alias("overlap"),
    )
    base = base.withColumn("before", F.lag(T).over(Window.partitionBy("plan").orderBy(T)))
    stays = held.join(base.select("plan", T, "before"), ["plan", T]).withColumn(
        "stays", F.coalesce(F.lag(T).over(Window.partitionBy("plan", SYM).orderBy(T)) == F.col("before"), F.lit(False)),
    )
    kept = stays.groupBy("plan", T).agg(F.sum(F.col("stays").cast("long")).alias("kept"))
    market = pool.groupBy(T).agg(F.avg("r").alias("even"), F.sum(F.col("w_cap") * F.col("r")).alias("weighted"))
    bench = pool.where("g >= 0").groupBy(T, "g").agg(F.sum("w_cap").alias("wb"))
    own = held.where("g >= 0").groupBy("plan", T, "g").agg(F.sum("w").alias("wi"))
    off = bench.join(base.select("plan", T), T).join(own, ["plan", T, "g"], "left").groupBy("plan", T).agg(
        F.max(F.abs(F.coalesce("wi", F.lit(0.0)) - F.col("wb"))).alias("industry_off")
    )
    out = base.join(kept, ["plan", T]).join(market, T).join(off, ["plan", T], "left")
    turn = F.when(F.col("before").isNull(), 1.0).otherwise(1 - F.col("kept") / F.col("names"))
    out = out.withColumn("turn", turn)
    return out.select(
        "plan", T, "names", "turn", "gross", (F.col("gross") - F.col("turn") * 2 * cost).alias("net"), "even", "weighted", "size_pct",
        "industry_off", "overlap",
    )


def buffered(rows: DataFrame, size: int, buffers: list[float], score: str, pool: str, step: int = FWD) -> DataFrame:
    """Holdings with a buffer, ``(buffer, pool, sym, t, stayed)``: names held stay while they rank within size * (1 + buffer); the best newcomers fill up.

    Each date's picks depend on the last date's, so this is a loop over dates; every pool and buffer is a group of its own, which
    holds at most size * (1 + buffer) names a date.
    """
    grid = on_grid(rows, step).where(F.col(score).isNotNull()).withColumn(
        "place", F.row_number().over(cs.section(pool).orderBy(F.col(score).desc(), F.col(SYM))),
    )
    grid = grid.withColumn("buffer", F.explode(F.array(*map(F.lit, buffers)))).where(
        F.col("place") <= F.floor(size * (1 + F.col("buffer")) + 1e-9)
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        out = []
        for t, day in pdf.sort_values([T, "place"]).groupby(T):
            ranked = sorted(day[SYM], key=lambda s: s not in held)[:size]  # a stable sort: names held first, each part by place
            out += [(pdf["buffer"].iloc[0], pdf[pool].iloc[0], s, t, s in held) for s in ranked]
            held = set(ranked)
        return pd.DataFrame(out, columns=["buffer", pool, SYM, T, "stayed"])

    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}
    return grid.select("buffer", pool, SYM, T, "place").groupBy("buffer", pool).applyInPandas(
        walk, f"buffer double, {pool} {kinds[pool]}, {SYM} {kinds[SYM]}, {T} {kinds[T]}, stayed boolean",
    )


def day_correlations(ranks: DataFrame, left: list[str], right: list[str], least: int = 20) -> DataFrame:
    """``t, a, b, c``: the correlation of every column in ``left`` with every column in ``right`` over the names of a date that have both.

    A date's names fit in a task (one market), so all pairs of a date are a few matrix products over it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[c].to_numpy(float, na_value=np.nan) for c in (left, right))
        mx, my = (~np.isnan(v) for v in (x, y))
        x, y, mx, my = np.where(mx, x, 0.0), np.where(my, y, 0.0), mx.astype(float), my.astype(float)
        n, sx, sy = mx.T @ my, x.T @ my, mx.T @ y
        with np.errstate(all="ignore"):
            cov, vx, vy = x.T @ y / n - sx * sy / n**2, (x * x).T @ my / n - (sx / n) ** 2, mx.T @ (y * y) / n - (sy / n) ** 2
            den = np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
            c = np.where((n >= least) & (den > 1e-12), cov / den, np.nan)
        i, j = np.nonzero(~np.isnan(c))
        return pd.DataFrame({T: rows[T].iloc[0], "a": np.array(left, object)[i], "b": np.array(right, object)[j], "c": c[i, j]})

    kind = ranks.schema[T].dataType.simpleString()
    cols = list(dict.fromkeys([*left, *right]))
    return ranks.select(T, *cols).groupBy(T).applyInPandas(run, f"{T} {kind}, a string, b string, c double")


def unlike_known(
    ranks: DataFrame, candidates: list[str], known: list[str], most: float = 0.7, step: int = FWD, least: int = 20,
) -> DataFrame:
    """For each candidate the largest median absolute correlation with a known factor, with which one, and whether it is new (below ``most``)."""
    grid = on_grid(ranks, step).select(T, *[cs.ordinal_rank(F.col(f)).alias(f) for f in dict.fromkeys([*candidates, *known])])
    days = day_correlations(grid, candidates, known, least)
    pairs = days.groupBy("a", "b").agg(F.percentile(F.abs("c"), F.lit(0.5)).alias("likeness"))
    return pairs.groupBy(F.col("a").alias("factor")).agg(
        F.max("likeness").alias("likeness"), F.max_by("b", F.struct("likeness", "b")).alias("like"),
    ).withColumn("new", F.col("likeness") < most)


def unlike_weights(streams: DataFrame, every: int = 20, window: int = 120, least: int = 60, most: float = 0.5) -> DataFrame:
    """Weights ``(t, id, w)`` from each evaluation date t on (every ``every`` rows): even over streams that are unlike each other.

    Looking at the last ``window`` dates before t only, streams are taken in order of mean over deviation while their Spearman
    correlation with all taken so far stays below ``most``.  Dates with fewer than ``least`` earlier ones give no weights.
    """
    dates = streams.select(T).distinct().withColumn("i", F.row_number().over(Window.orderBy(T)))
    # one row per date, then one per evaluation: how many dates lie before it; the windows run over these alone
    last = dates.groupBy(F.floor(F.col(T) / every).alias("k")).agg(F.max("i").alias("i")).select(((F.col("k") + 1) * every).alias("at"), "i")
    ev = dates.agg(F.max(T).alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / every) + 1)).alias("k"))
    ev = ev.select((F.col("k") * every).alias("at")).join(last, "at", "left")
    ev = ev.withColumn("upto", F.max("i").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= least)
    # the dates that an evaluation looks at are written out, so that rows meet it by equal dates
    seen = ev.select("at", F.explode(F.sequence(F.greatest(F.col("upto") - window + 1, F.lit(1)), F.col("upto"))).alias("i")).join(dates, "i")
    rows = streams.join(seen.select("at", T), T)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=T, columns="id", values="x")
        corr, sd = wide.corr(method="spearman"), wide.std()
        score = (wide.mean() / sd).where(sd > 0).fillna(-9.0)
        taken: list = []
        for name in sorted(score.index, key=lambda k: (-score[k], str(k))):
            if all(not abs(corr.loc[name, k]) >= most for k in taken):
                taken.append(name)
        return pd.DataFrame({T: pdf["at"].iloc[0], "id": taken, "w": 1.0 / len(taken)})

    kinds = {f.name: f.dataType.simpleString() for f in streams.schema}
    return rows.select("at", T, "id", "x").groupBy("at").applyInPandas(choose, f"{T} long, id {kinds['id']}, w double")

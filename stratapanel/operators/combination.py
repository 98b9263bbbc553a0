"""Correlation between factors and return streams, de-duplication, combination, constrained portfolios, and point-in-time joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cs
from ..functions.scan import scan, scans
from ..functions.ts import SYM, T, line


def _corr(x: str, y: str) -> Column:
    den = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(den > 1e-12, F.try_divide(F.covar_pop(x, y), den))


#: Streams of a tile, about.
TILE = 64


def stream_correlations(streams: DataFrame, least: int = 30, tile: int = TILE) -> DataFrame:
    """Spearman correlation of every pair of return streams (id, t, x) on their common dates; pairs with few dates are undecided.

    Each stream becomes one row, a vector over its dates; streams are dealt to tiles, and each pair of tiles is one group, in which the pairs are
    matrix products: of plain ranks where all streams have the same dates, else of ranks taken again on the dates that two streams share.
    """
    vectors = streams.where("x is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col(T).alias("t"), F.col("x").cast("double").alias("x")))).alias("v"))
    count = streams.select("id").distinct().count()
    tiles = max(1, -(-count // tile))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    dealt = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select("id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("v.t").alias("ts"), F.col("v.x").alias("xs"))
    kind = streams.schema["id"].dataType.simpleString()

    def ranked(x: np.ndarray) -> np.ndarray:
        return pd.DataFrame(x).rank(axis=1).to_numpy()

    def products(ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of dates and correlations of rows with the same dates: of all with all, or of one with one where ``rb`` has the shape of ``ra``."""
        ma = ~np.isnan(ra)
        n = ma.sum(1)
        mean = lambda r: np.where(ma, r, 0.0).sum(1) / np.maximum(n, 1)
        a, b = (np.where(ma, r - mean(r)[:, None], 0.0) for r in (ra, rb))
        den = np.sqrt((a * a).mean(1) * (b * b).mean(1)) * a.shape[1] / np.maximum(n, 1)
        with np.errstate(all="ignore"):
            return n, np.where(den > 1e-12, (a * b).sum(1) / n / den, np.nan)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        dates = np.unique(np.concatenate(rows["ts"].tolist()))
        x = np.full((len(rows), len(dates)), np.nan)
        for i, (ts, xs) in enumerate(zip(rows["ts"], rows["xs"], strict=True)):
            x[i, np.searchsorted(dates, ts)] = xs
        ids, side = rows["id"].to_numpy(), rows["own"].to_numpy()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        whole = not np.isnan(x).any()
        if whole:
            r = ranked(x)
            r -= r.mean(1)[:, None]
            sd = np.sqrt((r * r).mean(1))
            with np.errstate(all="ignore"):
                c = np.where(np.outer(sd, sd) > 1e-12, r @ r.T / r.shape[1] / np.outer(sd, sd), np.nan)
        out = []
        for i in left:
            j = right[ids[right] > ids[i]] if lo == hi else right
            if not len(j):
                continue
            if whole:
                n, corr = np.full(len(j), len(dates)), c[i, j]
            else:
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                n, corr = products(ranked(np.where(both, x[i], np.nan)), ranked(np.where(both, x[j], np.nan)))
            met = n > 0
            swap = ids[j] < ids[i]
            out.append(pd.DataFrame({"a": np.where(swap, ids[j], ids[i]), "b": np.where(swap, ids[i], ids[j]), "n": n, "corr": np.where(n >= least, corr, np.nan)})[met])
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": [], "corr": []})

    found = dealt.groupBy("lo", "hi").applyInPandas(run, f"a {kind}, b {kind}, n long, corr double")
    return found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def largest_correlation(pairs: DataFrame) -> DataFrame:
    """For each stream its largest absolute correlation and with whom."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "corr").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "corr")
    )
    held = both.where("corr is not null")
    top = F.struct(F.abs("corr").alias("c"), (-F.col("other")).alias("o"))
    return held.groupBy("id").agg(F.max(top).alias("m")).select("id", F.col("m.c").alias("max_corr"), (-F.col("m.o")).alias("with_id"))


def factor_similarity(ranks: DataFrame, factors: list[str], step: int = 5, least: int = 20) -> DataFrame:
    """Median over rebalancing dates of the absolute correlation of the factors' ordinal ranks, per pair of factors."""
    from .portfolios import day_correlations

    grid = ranks.where(F.col(T) % step == 0).select(T, *[cs.ordinal_rank(F.col(f)).alias(f) for f in factors])
    days = day_correlations(grid, factors, factors, least).where("a < b")
    return days.groupBy("a", "b").agg(F.percentile(F.abs("c"), F.lit(0.5)).alias("similarity"), F.count("c").alias("days"))


def combine_equal(ranks: DataFrame, factors: list[str]) -> DataFrame:
    """Mean of the factors' percentile ranks over those that are present."""
    return _weighted(ranks, factors, {f: F.lit(1.0) for f in factors})


def _weighted(rows: DataFrame, factors: list[str], weight: dict[str, Column]) -> DataFrame:
    top = sum((F.when(F.col(f).isNotNull(), F.col(f) * F.coalesce(weight[f], F.lit(0.0))).otherwise(0.0) for f in factors), F.lit(0.0))
    bottom = sum((F.when(F.col(f).isNotNull(), F.coalesce(weight[f], F.lit(0.0))).otherwise(0.0) for f in factors), F.lit(0.0))
    return rows.withColumn("combo", F.when(bottom > 1e-12, F.try_divide(top, bottom)))


def combine_by_ic(ranks: DataFrame, ics: DataFrame, factors: list[str], window: int = 250, least: int = 30) -> DataFrame:
    """Weights are the factors' mean IC over the ``window`` dates before (today's is not known yet; at least ``least`` dates), negative
    ones as 0; even weights where none is positive."""
    past = Window.orderBy(T).rowsBetween(-window, -1)
    mean = lambda f: F.when(F.count(f).over(past) >= least, F.avg(f).over(past))
    weights = ics.select(T, *[F.greatest(F.coalesce(mean(f), F.lit(0.0)), F.lit(0.0)).alias(f"w_{f}") for f in factors])
    joined = ranks.join(weights, T, "left")
    total = sum((F.coalesce(f"w_{f}", F.lit(0.0)) for f in factors), F.lit(0.0))
    return _weighted(joined, factors, {f: F.when(total > 0, F.col(f"w_{f}")).otherwise(1.0) for f in factors})


def constrained(rows: DataFrame, size: int, industry: str, cap: str, score: str) -> DataFrame:
    """At most ``size`` names per date: of each industry the best ones, as many as its share of the market value says (rounded), then the best of these."""
    pool = rows.where(f"{score} is not null and {cap} is not null")
    share = F.try_divide(F.sum(cap).over(cs.section(industry)), F.sum(cap).over(cs.section()))
    pool = pool.withColumn("quota", F.round(share * size))
    pool = pool.withColumn("place", F.row_number().over(cs.section(industry).orderBy(F.col(score).desc(), F.col(SYM))))
    picked = pool.where(F.col("place") <= F.col("quota"))
    picked = picked.withColumn("overall", F.row_number().over(cs.section().orderBy(F.col(score).desc(), F.col(SYM))))
    return picked.where(F.col("overall") <= size).select(SYM, T, industry, score, "quota", "place")


def combine_by_choice(ranks: DataFrame, weights: DataFrame, factors: list[str]) -> DataFrame:
    """Weighted mean of the ranks by the ``weights`` (t, id, w) of the last evaluation at or before each date; none before the first."""
    chosen = weights.groupBy(T).agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "w"))).alias("__m"))
    dates = ranks.select(T).distinct().withColumn("__all", F.lit(0))
    held = as_of(dates, chosen.withColumn("__all", F.lit(0)), "__all", T, ["__m"]).drop("__all")
    return _weighted(ranks.join(held, T), factors, {f: F.try_element_at("__m", F.lit(f)) for f in factors}).drop("__m")


# Point-in-time joins.


def as_of(left: DataFrame, right: DataFrame, key: str, when: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (``strict``: before).

    A union sorted by time and one running ``last`` do it: one shuffle by key, no range join, nothing multiplied.
    """
    l_ = left.withColumn("__side", F.lit(0 if strict else 1)).withColumn(
        "__v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType),
    )
    l_ = l_.select(F.col(key).alias("__k"), F.col(when).alias("__t"), "__side", "__v", F.struct(*left.columns).alias("__row"))
    r_ = right.select(
        F.col(key).alias("__k"), F.col(when).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.struct(*values).alias("__v"),
        F.lit(None).cast(l_.schema["__row"].dataType).alias("__row"),
    )
    over = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_).withColumn("__found", F.last("__v", ignorenulls=True).over(over))
    return both.where("__row is not null").select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def members_at(dates: DataFrame, changes: DataFrame) -> DataFrame:
    """Pool membership per date: the member list of the last change at or before it; none before the first change.

    ``changes`` are (pool, changed, sym) rows with ordinals of dates; each list is valid until the pool's next change.  The dates of a
    list are written out, one row per pool and date, so that both joins are by equal keys.
    """
    lists = changes.select("pool", "changed").distinct()
    last = dates.agg(F.max(T)).head()[0]
    until = F.coalesce(F.lead("changed").over(Window.partitionBy("pool").orderBy("changed")), F.lit(last) + 1)
    lists = lists.withColumn("until", until).where((F.col("changed") < F.col("until")) & (F.col("changed") <= F.lit(last)))
    valid = lists.select("pool", "changed", F.explode(F.sequence("changed", F.least(F.col("until") - 1, F.lit(last)))).alias(T))
    return valid.join(dates.select(T).distinct(), T).join(changes.select("pool", "changed", SYM), ["pool", "changed"]).select("pool", T, SYM)


def adjust_prices(prices: DataFrame, factors: DataFrame, cols: list[str], volume: str | None = None, least: int = 20) -> DataFrame:
    """Forward-adjust: the cumulative factor as of each date over the symbol's last one; prices times it, volume divided.  Symbols with fewer than
    ``least`` rows with a price are left out."""
    known = F.count(cols[0]).over(Window.partitionBy(SYM))
    prices = prices.withColumn("__known", known).where(F.col("__known") >= least).drop("__known")
    frame = as_of(prices, factors.withColumnRenamed("start", T), SYM, T, ["factor"])
    last = F.last("factor", ignorenulls=True).over(
        Window.partitionBy(SYM).orderBy(T).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    ratio = F.coalesce(F.try_divide(F.col("factor"), last), F.lit(1.0))
    made = {c: F.col(c) * ratio for c in cols} | ({volume: F.try_divide(F.col(volume), ratio)} if volume else {})
    return frame.withColumn("__ratio", ratio).withColumns({k: v for k, v in made.items()}).drop("__ratio", "factor")


def with_flags(panel: DataFrame, lists: DataFrame, flags: list[str]) -> DataFrame:
    """``panel`` with a boolean column per flag: whether the date is in the symbol's list (``lists`` has sym and an array of dates per flag)."""
    days = [lists.select(SYM, F.explode(c).alias(T), F.lit(c).alias("flag")) for c in flags]
    long = days[0]
    for d in days[1:]:
        long = long.unionByName(d)
    hits = long.groupBy(SYM, T).agg(*[F.max((F.col("flag") == c).cast("int")).alias(c) for c in flags])
    return panel.join(hits, [SYM, T], "left").withColumns({c: F.coalesce(F.col(c) == 1, F.lit(False)) for c in flags})


def universe(panel: DataFrame, age: int = 250, window: int = 20, least_seen: int = 10, amount: float = 1e7) -> Column:
    """Whether a symbol may be chosen: listed for ``age`` sessions, not past its last day, with a price, free of the flags ``st`` and
    ``suspended``, liquid over the last rows, and closed strictly inside ``limit_up`` and ``limit_down`` (unknown limits: no).

    ``listed`` and ``delisted`` are ordinals of dates (NULL: always there); a column that the panel lacks is no condition, but for limits.
    """
    has = lambda c: c in panel.columns
    over = line().rowsBetween(-(window - 1), 0)
    tests = [F.col("close").isNotNull(), F.count("turnover").over(over) >= least_seen, F.avg("turnover").over(over) >= amount]
    tests += [F.col("close") < F.col("limit_up") - 1e-6, F.col("close") > F.col("limit_down") + 1e-6]
    if has("listed"):
        tests.append(F.col(T) - F.coalesce(F.col("listed") + 1, F.lit(0)) >= age)
    if has("delisted"):
        tests.append(F.col("delisted").isNull() | (F.col(T) <= F.col("delisted")))
    tests += [~F.coalesce(F.col(c), F.lit(False)) for c in ("st", "suspended") if has(c)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def concentration(
    panel: DataFrame, shares: tuple[float, ...] = (0.05, 0.1, 0.2, 0.5), spans: dict[str, int] | None = None, least: int = 243,
) -> DataFrame:
    """Share of each date's turnover in its largest names, and its percentile rank within the rows of each span (NULL with fewer than
    ``least``); spans default to three and ten years.  One row per date is ranked, so its windows need no key."""
    held = panel.where("turnover is not null")
    ranked = held.select(
        T, "turnover", F.row_number().over(cs.section().orderBy(F.col("turnover").desc(), F.col(SYM))).alias("k"),
        F.count("*").over(cs.section()).alias("n"),
    )
    top = lambda p: F.sum(F.when(F.col("k") <= F.greatest(F.floor(F.col("n") * p), F.lit(1)), F.col("turnover")))
    names = [f"top{int(p * 100)}" for p in shares]
    per = ranked.groupBy(T).agg(*[F.try_divide(top(p), F.sum("turnover")).alias(c) for p, c in zip(shares, names, strict=True)])

    wanted = {f"{c}_{k}": scan("pct_rank", c, w, least, span=True) for c in names for k, w in (spans or {"3y": 729, "10y": 2430}).items()}
    return scans(per.withColumn("__all", F.lit(0)), wanted, key="__all").drop("__all")

"""Scoring a factor: rank IC, stability, decile shape, style exposure.  Input rows are (sym, t, f, r, ...): the factor and the
forward return, both NULL where missing.  Thresholds default to those of full markets; small tables pass smaller ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cs
from ..functions.ts import SYM, T

FWD, GROUPS, YEAR = 5, 10, 243


def _corr(x: str, y: str) -> Column:
    """Correlation of a group by moments; NULL where a side is flat (the built-in raises there under ANSI)."""
    den = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(den > 1e-12, F.try_divide(F.covar_pop(x, y), den))


def daily_ic(rows: DataFrame, least: int = 50) -> DataFrame:
    """Spearman correlation of factor and return per date, with average-tie ranks of the pairs that are both present."""
    pairs = rows.where("f is not null and r is not null")
    ranked = pairs.select(T, cs.average_rank(F.col("f")).alias("x"), cs.average_rank(F.col("r")).alias("y"))
    days = ranked.groupBy(T).agg(F.count("*").alias("n"), _corr("x", "y").alias("ic"))
    return days.where(F.col("n") >= least)


def eligible(rows: DataFrame, first: int | None = None, inside: Column | None = None) -> DataFrame:
    """Rows from a date on, with the factor only where a symbol may be chosen; others keep their rows, so that windows stay whole."""
    rows = rows if inside is None else rows.withColumn("f", F.when(F.coalesce(inside, F.lit(False)), F.col("f")))
    return rows if first is None else rows.where(F.col(T) >= first)


def ic_summary(days: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return days.agg(
        F.count("ic").alias("days"), F.avg("ic").alias("ic"), F.when(sd > 1e-12, F.try_divide(F.avg("ic"), sd)).alias("ic_ir"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("int"))).alias("ic_win"),
    )


def batch_ic(rows: DataFrame, factors: list[str], least: int = 50) -> DataFrame:
    """IC of many factor columns at once: ordinal ranks of the whole section before pairs are formed; population deviation."""
    ranked = rows.select(T, cs.ordinal_rank(F.col("r")).alias("__r"), *[cs.ordinal_rank(F.col(f)).alias(f) for f in factors])
    long = ranked.select(
        T, "__r", F.expr(f"stack({len(factors)}, {', '.join(f'{chr(39)}{f}{chr(39)}, {f}' for f in factors)}) as (factor, x)"),
    )
    days = long.where("x is not null and __r is not null").groupBy("factor", T).agg(
        F.count("*").alias("n"), _corr("x", "__r").alias("ic"),
    ).where(F.col("n") >= least)
    sd = F.stddev_pop("ic")
    return days.groupBy("factor").agg(
        F.count("ic").alias("days"), F.avg("ic").alias("ic"), F.when(sd > 1e-12, F.try_divide(F.avg("ic"), sd)).alias("ic_ir"),
    )


def on_grid(rows: DataFrame, step: int = FWD) -> DataFrame:
    """Rebalancing rows: every ``step``-th date from the first."""
    return rows.where(F.col(T) % step == 0)


def stability(rows: DataFrame, step: int = FWD, least: int = 50) -> DataFrame:
    """Correlation of the factor's ordinal ranks between consecutive rebalancing dates: per period, before the mean."""
    ranked = on_grid(rows, step).select(SYM, T, cs.ordinal_rank(F.col("f")).alias("x"))
    # the next rank of a symbol is the next grid row of the same symbol, so a window does what a self-join would
    after = F.lead("x").over(Window.partitionBy(SYM).orderBy(T))
    pairs = ranked.withColumn("y", after).where("x is not null and y is not null")
    return pairs.groupBy(T).agg(F.count("*").alias("n"), _corr("x", "y").alias("corr")).where(F.col("n") >= least)


def _deciles(rows: DataFrame, step: int, least: int) -> DataFrame:
    """(sym, t, r, d): the decile (1 = top) of every name with a factor and a return; ranks are those of the whole section."""
    ranked = on_grid(rows, step).select(SYM, T, "r", cs.ordinal_rank(F.col("f")).alias("x")).where("x is not null and r is not null")
    return ranked.withColumn("n", F.count("*").over(cs.section())).where(F.col("n") >= least).select(
        SYM, T, "r", (cs.bucket_top(F.col("x")) + 1).alias("d"),
    )


def decile_periods(rows: DataFrame, step: int = FWD, least: int = 100, least_in_bucket: int = 5) -> DataFrame:
    """Mean return per period and decile (1 = top)."""
    return _deciles(rows, step, least).groupBy(T, "d").agg(
        F.avg("r").alias("ret"), F.count("*").alias("n"),
    ).where(F.col("n") >= least_in_bucket)


def decile_shape(rows: DataFrame, step: int = FWD, least: int = 100, least_in_bucket: int = 5) -> DataFrame:
    """Monotony (correlation of bucket 10..1 with its mean return, where all ten are known), best bucket, the mean of the first, the last
    and the top fifth, deviations of the first, of the spread and of the top fifth, and the turnover of the first bucket.

    The top fifth of a period needs twice ``least_in_bucket`` names, a deviation five periods.  The turnover is 1 - Jaccard overlap
    of the first bucket in consecutive periods that have one.
    """
    names = _deciles(rows, step, least)
    buckets = names.groupBy(T, "d").agg(F.avg("r").alias("ret"), F.count("*").alias("n"), F.sum("r").alias("s"))
    fine = F.when(F.col("n") >= least_in_bucket, F.col("ret"))
    two = F.col("d") <= 2
    held = F.sum(F.when(two, F.col("n")))
    per = buckets.groupBy(T).agg(
        *[
            F.max(F.when(F.col("d") == k, fine)).alias(f"b{k}") for k in range(1, GROUPS + 1)
        ], F.when(held >= 2 * least_in_bucket, F.sum(F.when(two, F.col("s"))) / held).alias("top20"),
        F.max(F.when(F.col("d") == 1, F.col("n"))).alias("n1"),
    )
    top = names.where("d = 1").select(SYM, T)
    order = Window.orderBy(T)
    sized = per.where("n1 is not null").select(T, "n1", F.lag(T).over(order).alias("before"), F.lag("n1").over(order).alias("n0"))
    stays = top.join(sized, T).withColumn(
        "stays", F.coalesce(F.lag(T).over(Window.partitionBy(SYM).orderBy(T)) == F.col("before"), F.lit(False)).cast("long"),
    )
    moved = stays.where("before is not null").groupBy(T).agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), F.sum("stays").alias("both"))
    turn = moved.agg((1 - F.avg(F.col("both") / (F.col("n1") + F.col("n0") - F.col("both")))).alias("turn_top"))
    deviation = lambda c: F.when(F.count(c) >= 5, F.stddev_pop(c))
    out = per.agg(
        F.count("*").alias("periods"), *[
            F.avg(f"b{k}").alias(f"m{k}") for k in range(1, GROUPS + 1)
        ], deviation(F.col("b1")).alias("sd_top"), deviation(F.col("b1") - F.col(f"b{GROUPS}")).alias("sd_spread"),
        F.avg("top20").alias("top20"), deviation(F.col("top20")).alias("sd_top20"),
    )
    means = F.array(*[F.struct(F.col(f"m{k}").alias("m"), F.lit(-k).alias("k")) for k in range(1, GROUPS + 1)])
    known = F.filter(means, lambda x: x["m"].isNotNull())
    score = [(GROUPS + 1) / 2 - k for k in range(1, GROUPS + 1)]
    centre = sum((F.col(f"m{k}") for k in range(2, GROUPS + 1)), F.col("m1")) / GROUPS
    sd = F.sqrt(sum((F.pow(F.col(f"m{k}") - centre, 2) for k in range(1, GROUPS + 1)), F.lit(0.0)) * sum(x * x for x in score))
    mono = F.when(sd > 1e-18, F.try_divide(sum((F.col(f"m{k}") * x for k, x in enumerate(score, 1)), F.lit(0.0)), sd))
    best = -F.array_max(known)["k"]
    out = out.withColumns({"mono": mono, "best": best})
    pos = F.when(
        F.col("mono").isNotNull(), F.least(F.greatest("mono", F.lit(0.0)), F.lit(1.0)) * F.when(F.col("best") == 1, 1.0).otherwise(0.5),
    )
    return out.crossJoin(turn).select(
        "mono", "best", pos.alias("shape_pos"), F.col("m1").alias("d1"), F.col(f"m{GROUPS}").alias("d10"), "sd_top", "sd_spread", "top20",
        "sd_top20", "turn_top", "periods",
    )


def top_turnover(rows: DataFrame, step: int = FWD, share: float = 0.2) -> DataFrame:
    """1 - Jaccard overlap of the top sets of consecutive periods."""
    ranked = on_grid(rows, step).select(SYM, T, cs.ordinal_rank(F.col("f")).alias("x"))
    top = ranked.where(F.col("x") >= 1 - share)
    line = Window.partitionBy(SYM).orderBy(T)
    stays = top.withColumn("stays", (F.lag(T).over(line) == F.col(T) - step).cast("int"))
    per = stays.groupBy(T).agg(F.count("*").alias("n"), F.sum(F.coalesce("stays", F.lit(0))).alias("both"))
    per = per.withColumn("before", F.lag("n").over(Window.orderBy(T)))
    return per.where("before is not null").select(T, (1 - F.col("both") / (F.col("n") + F.col("before") - F.col("both"))).alias("turnover"))


def style_exposure(rows: DataFrame, styles: list[str], least: int = 100) -> DataFrame:
    """Mean over dates of the correlation of the factor's ordinal rank with each style's."""
    ranked = rows.select(T, cs.ordinal_rank(F.col("f")).alias("x"), *[cs.ordinal_rank(F.col(s)).alias(s) for s in styles])
    long = ranked.select(T, "x", F.expr(f"stack({len(styles)}, {', '.join(f'{chr(39)}{s}{chr(39)}, {s}' for s in styles)}) as (style, y)"))
    days = long.where("x is not null and y is not null").groupBy("style", T).agg(
        F.count("*").alias("n"), _corr("x", "y").alias("c"),
    ).where(F.col("n") >= least)
    return days.groupBy("style").agg(F.avg("c").alias("expo"), F.count("c").alias("days"))


def style_features(panel: DataFrame) -> DataFrame:
    """Log of market value, of the 20-row mean amount (5 at least), of turnover ratio, and of price; NULL unless positive."""
    positive = lambda x: F.when(x > 0, F.log(x))
    over = Window.partitionBy(SYM).orderBy(T).rowsBetween(-19, 0)
    amount = F.when(F.count("turnover").over(over) >= 5, F.avg("turnover").over(over))
    ratio = F.try_divide(F.col("turnover"), F.col("mktcap"))
    return panel.withColumns(
        {"lncap": positive(F.col("mktcap")), "lnamt": positive(amount), "lntr": positive(ratio), "lnpx": positive(F.col("close"))}
    )


def neutralize_rows(rows: DataFrame, y: str, styles: list[str], out: str, least: int = 50) -> DataFrame:
    """``rows`` with the residual of ``y`` on the styles per date in ``out``; rows that lack a style, and dates with fewer than ``least``
    complete rows, keep ``y``."""
    made = many_regressor_residual(rows, y, styles, least).select(SYM, T, F.col("residual").alias("__left"))
    return rows.join(made, [SYM, T], "left").withColumn(out, F.coalesce("__left", F.col(y))).drop("__left")


def neutral_ic(rows: DataFrame, factors: list[str], styles: list[str], step: int = FWD, least: int = 50) -> DataFrame:
    """Absolute mean IC of factors with the part of the return that the styles don't explain, on rebalancing dates."""
    grid = neutralize_rows(on_grid(rows, step), "r", styles, "__r0", least).withColumn("r", F.col("__r0"))
    return batch_ic(grid, factors, least).select("factor", "days", F.abs("ic").alias("ic_n"))


def neutral_rank(f: Column, z1: Column, z2: Column, least: int = 100) -> tuple[list[tuple[str, Column]], Column]:
    """Steps (name, column) to add one after another, and the final column: rank all, take the residual, rank again."""
    all_ = f.isNotNull() & z1.isNotNull() & z2.isNotNull()
    steps = [("__f", F.when(all_, f)), ("__z1", F.when(all_, z1)), ("__z2", F.when(all_, z2))]
    steps += [
        ("__n", F.count("__f").over(cs.section())), ("__rf", cs.ordinal_rank(F.col("__f"))), ("__r1", cs.ordinal_rank(F.col("__z1"))),
        ("__r2", cs.ordinal_rank(F.col("__z2"))),
    ]
    steps += [("__res", cs.residual_two(F.col("__rf"), F.col("__r1"), F.col("__r2")))]
    return steps, F.when(F.col("__n") >= least, cs.ordinal_rank(F.col("__res")))


def neutralised(rows: DataFrame, f: str, z1: str, z2: str, out: str, least: int = 100) -> DataFrame:
    steps, final = neutral_rank(F.col(f), F.col(z1), F.col(z2), least)
    names = [n for n, _ in steps]
    frame = rows
    for group in (steps[:3], steps[3:7], steps[7:]):
        frame = frame.withColumns(dict(group))
    return frame.withColumn(out, final).drop(*names)


def industry_size_neutral(rows: DataFrame, f: str, size: str, industry: str, least: int = 5) -> DataFrame:
    """``neutral``: the factor less its industry's mean, less what size (less its industry's mean) explains of that, per date; and whether
    that is ``degenerate``: hardly anything is left (the 99.5th percentile of its size is within a thousandth of the factor's deviation).

    Names without an industry are one more group; groups with fewer than ``least`` names keep their level.
    """
    both = F.col(f).isNotNull() & F.col(size).isNotNull()
    frame = rows.withColumns({"__f": F.when(both, F.col(f)), "__z": F.when(both, F.col(size)), "__g": F.coalesce(F.col(industry), F.lit(-1))})
    many = F.count("__f").over(cs.section("__g")) >= least
    within = {c: F.when(many, cs.cs_demean(F.col(c), "__g")).otherwise(F.col(c)) for c in ("__f", "__z")}
    frame = frame.withColumns({"__sd": F.stddev_pop("__f").over(cs.section())} | {f"{c}i": x for c, x in within.items()})
    over = cs.section()
    var = F.var_pop("__zi").over(over)
    beta = F.when(F.sqrt(var) > 1e-12, F.try_divide(F.covar_pop("__fi", "__zi").over(over), var)).otherwise(0.0)
    frame = frame.withColumn("neutral", F.col("__fi") - beta * F.col("__zi"))
    left = F.percentile(F.abs("neutral"), F.lit(0.995)).over(over)
    return frame.withColumn("degenerate", left <= 1e-3 * F.col("__sd")).drop("__f", "__z", "__g", "__sd", "__fi", "__zi")


def industry_r2(rows: DataFrame, f: str, industry: str) -> DataFrame:
    """1 - within / total variance per date."""
    held = rows.where(F.col(f).isNotNull()).withColumn("__m", F.avg(f).over(cs.section(industry)))
    per = held.groupBy(T).agg(
        F.count("*").alias("n"), F.var_pop(f).alias("total"), F.avg(F.pow(F.col(f) - F.col("__m"), 2)).alias("within"),
    )
    return per.select(T, "n", F.when(F.col("total") > 1e-12, 1 - F.try_divide("within", "total")).alias("r2"))


def many_regressor_residual(rows: DataFrame, f: str, regressors: list[str], least: int = 200) -> DataFrame:
    """Residual of the factor on any number of regressors per date.

    The normal equations are sums per date, (k + 1)(k + 2) / 2 of them; each date's small system is solved where its sums are,
    and the coefficients go back to the rows.  No date's rows are gathered in one task.
    """
    names = ["__one", *regressors]
    held = rows.where(" and ".join(f"`{c}` is not null" for c in (f, *regressors))).withColumn("__one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate([*names, f]) for b in [*names, f][i:]]
    sums = held.groupBy(T).agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("m"),
    ).where(F.col("n") >= least)

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series) -> pd.Series:
        k, out = len(names), []
        for flat in m:
            full = np.zeros((k + 1, k + 1))
            full[np.triu_indices(k + 1)] = flat
            full = full + np.triu(full, 1).T
            out.append(np.linalg.lstsq(full[:k, :k], full[:k, k], rcond=None)[0])
        return pd.Series(out)

    beta = sums.select(T, solve("m").alias("b"))
    fit = sum((F.col("b")[i] * F.col(c) for i, c in enumerate(names[1:], 1)), F.col("b")[0])
    return held.join(F.broadcast(beta), T).withColumn("residual", F.col(f) - fit).drop("b", "__one")


def sweep(gram: np.ndarray, k: int) -> np.ndarray:
    """Sweep a matrix of sums of products on variable ``k``: the regression on one variable more.  One that adds nothing gets no weight."""
    pivot = gram[k, k]
    if abs(pivot) < 1e-9:
        out = gram.copy()
        out[k], out[:, k] = 0.0, 0.0
        return out
    out = gram - np.outer(gram[:, k], gram[k]) / pivot
    out[k], out[:, k] = gram[k] / pivot, gram[:, k] / pivot
    out[k, k] = -1 / pivot
    return out


def nested_residuals(rows: DataFrame, f: str, models: dict[str, list[str]], least: int = 100) -> DataFrame:
    """``rows`` with, per model, what a regression of ``f`` on [1, its regressors] leaves per date, NULL where ``f`` or a regressor is missing or
    fewer than ``least`` rows have all.

    One pass makes, per date and pattern of missing regressors, the sums of products of everything with everything.  A model's sums are those
    of the patterns that have its regressors; sweeping one regressor after the other gives the coefficients of all models from them, and
    models that begin alike share their sweeps.  No date's rows are gathered in one task.
    """
    names = list(dict.fromkeys(c for held in models.values() for c in held))
    pattern = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    value = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in (*names, f)} | {"__one": F.lit(1.0)}
    terms = ["__one", *names, f]
    products = [value[a] * value[b] for i, a in enumerate(terms) for b in terms[i:]]
    sums = rows.where(F.col(f).isNotNull()).groupBy(T, pattern.alias("pattern")).agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in products]).alias("m"))
    wanted = [[names.index(c) for c in held] for held in models.values()]
    size = len(terms)

    @F.pandas_udf("array<array<double>>")
    def solve(groups: pd.Series) -> pd.Series:
        out = []
        for held in groups:
            grams = {}
            for g in held:
                full = np.zeros((size, size))
                full[np.triu_indices(size)] = g["m"]
                grams[g["pattern"]] = (g["n"], full + np.triu(full, 1).T)
            done: dict = {}
            found = []
            for model in wanted:
                need = sum(1 << i for i in model)
                fits = tuple(sorted(p for p in grams if p & need == need))
                if sum(grams[p][0] for p in fits) < least:
                    found.append(None)
                    continue
                for upto in range(len(model) + 1):
                    key = (fits, tuple(model[:upto]))
                    if key not in done:
                        done[key] = sweep(sum(grams[p][1] for p in fits), 0) if not upto else sweep(done[fits, tuple(model[:upto - 1])], model[upto - 1] + 1)
                coefficient = np.zeros(size - 1)
                at = [0, *[i + 1 for i in model]]
                coefficient[at] = done[fits, tuple(model)][at, -1]
                found.append(coefficient.tolist())
            out.append(found)
        return pd.Series(out)

    solved = sums.groupBy(T).agg(F.collect_list(F.struct("pattern", "n", "m")).alias("g")).select(T, solve("g").alias("__b"))
    joined = rows.join(solved, T, "left")
    made = {}
    for k, (name, held) in enumerate(models.items()):
        b = lambda i, k=k: F.get(F.get("__b", F.lit(k)), F.lit(i))
        made[name] = F.col(f) - sum((b(names.index(c) + 1) * F.col(c) for c in held), b(0))
    return joined.withColumns(made).drop("__b")


def style_ladder(rows: DataFrame, f: str, models: dict[str, list[str]], step: int = FWD, least: int = 100, share: float = 0.1) -> DataFrame:
    """For each model, what is left of the factor once its styles are stripped (ranks regressed on ranks, ranked again): dates, mean rank IC, and the
    mean return of the best ``share`` of names less all names'.  All models come from one pass of sums."""
    grid = on_grid(rows, step)
    styles = list(dict.fromkeys(c for held in models.values() for c in held))
    ranked = grid.select(SYM, T, "r", cs.ordinal_rank(F.col(f)).alias("__f"), *[cs.ordinal_rank(F.col(c)).alias(c) for c in styles])
    left = nested_residuals(ranked, "__f", models, least)
    long = left.select(SYM, T, "r", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("v")) for k in models])).alias("x"))
    long = long.select("x.model", SYM, T, "r", F.col("x.v").alias("v")).where("v is not null and r is not null")
    per = lambda *c: Window.partitionBy("model", T).orderBy(*c)
    mid = lambda c: F.rank().over(per(c)) + (F.count(F.lit(1)).over(Window.partitionBy("model", T, c)) - 1) / 2
    n = F.count(F.lit(1)).over(Window.partitionBy("model", T))
    long = long.withColumns({"a": mid("v"), "b": mid("r"), "n": n, "place": F.row_number().over(per(F.col("v").desc(), F.col(SYM)))})
    top = F.when(F.col("place") <= F.greatest(F.floor(F.col("n") * share), F.lit(1)), F.col("r"))
    days = long.where(F.col("n") >= least).groupBy("model", T).agg(_corr("a", "b").alias("ic"), (F.avg(top) - F.avg("r")).alias("excess"))
    return days.groupBy("model").agg(F.count("*").alias("days"), F.avg("ic").alias("ic"), F.avg("excess").alias("excess"))

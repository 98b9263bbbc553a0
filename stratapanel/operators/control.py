"""Gates, tags and grades of factors, as columns over tables of metrics; undecided is NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(<=|>=|==|!=|<|>)\s*(-?[0-9.]+(?:[eE]-?[0-9]+)?)\s*\Z")


def rule(text: str) -> Column:
    """'metric op number and ...' as a column; a missing metric fails its clause."""
    out = F.lit(True)
    for clause in re.split(r"\band\b", text):
        m = _CLAUSE.match(clause)
        if not m:
            raise ValueError(f"not a clause: {clause!r}")
        col, value = F.col(m[1]), F.lit(float(m[3]))
        test = {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value, "==": col == value, "!=": col != value}[m[2]]
        out = out & F.coalesce(test, F.lit(False))
    return out


def passes(least_ic: float = 0.02, least_win: float = 0.52, least_calmar: float = 0.5) -> Column:
    """The basic filter: |ic|, ic_win, calmar, a positive last year, and at most one year of -2 % or worse (``bad_years``)."""
    return (F.abs("ic") >= least_ic) & (F.col("ic_win") >= least_win) & (F.col("calmar") >= least_calmar) & (F.col("last_yr") > 0) & (F.col("bad_years") <= 1)


def segments_hold(positive: Column, periods: Column, k: int = 3, need: int = 2, least: int = 40) -> Column:
    """At least ``need`` of the ``k`` segments of a stream are positive; streams with fewer than k * ``least`` periods are not judged and pass."""
    return (F.coalesce(periods, F.lit(0)) < k * least) | F.coalesce(positive >= min(need, k), F.lit(False))


def pool_gate(pools: list[Column], least: float, mode: str = "any") -> Column:
    """The best (any) or worst (all) pool figure reaches ``least``; NULL without data."""
    found = F.array_compact(F.array(*pools))
    value = F.array_max(found) if mode == "any" else F.array_min(found)
    return F.when(F.size(found) > 0, value >= least)


def combined(base: Column, whole: Column, pool: Column, hard: Column, pool_on: bool = True, either: bool = False) -> Column:
    """Admission from three gates: ``base`` and ``hard`` must hold whatever happens; of the figures in the ``whole`` market and in the
    ``pool`` both are needed, or one with ``either``.  An undecided (NULL) pool, or ``pool_on`` off, leaves the whole market alone."""
    b, w, h = (F.coalesce(x, F.lit(False)) for x in (base, whole, hard))
    asked = F.when(pool.isNull(), w).when(F.lit(either), w | pool).otherwise(w & pool) if pool_on else w
    return b & asked & h


def stripped_channel(
    ic: Column, calmar: Column, ann: Column, sharpe: Column, likeness: Column,
    least: tuple[float, float, float, float] = (0.02, 0.5, 0.03, 0.8), most_alike: float = 0.9,
) -> Column:
    """Admission on figures without styles only: |ic|, Calmar, annual excess and Sharpe (the last three above their bounds), and no
    stream in the library that is more alike than ``most_alike`` (NULL: none to compare).  Missing figures fail."""
    held = (F.abs(ic) >= least[0]) & (calmar > least[1]) & (ann > least[2]) & (sharpe > least[3])
    return F.coalesce(held, F.lit(False)) & F.coalesce(likeness <= most_alike, F.lit(True))


def either_horizon(first: Column, second: Column) -> Column:
    """A factor passes with the gates of its own horizon or with those of the second one; missing figures fail."""
    return F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False))


def first_score(mode: str, stab: Column, ic_ir: Column, shape: Column, ic_n: Column, mono_n: Column) -> Column:
    """The score candidates are sorted by: ``old`` (IC ratio and stability), ``new`` (stability and shape), ``ic_n`` or ``mono_n``."""
    unit = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    if mode == "mono_n":
        return unit(mono_n)
    if mode == "ic_n":
        return F.greatest(F.coalesce(ic_n, F.lit(0.0)), F.lit(0.0))
    if mode == "new":
        return unit(stab) * (0.5 + 0.5 * unit(shape))
    if mode == "old":
        return F.abs(ic_ir) * (0.25 + 0.75 * F.when(stab.isNotNull(), unit(stab)))
    raise ValueError(f"no such score: {mode}")


def pool_tag(in300: Column, in500: Column, whole: Column) -> Column:
    """Where a factor works: in the whole market and each of two index pools."""
    a, b, c = (F.coalesce(x, F.lit(False)) for x in (in300, in500, whole))
    return (
        F.when(a & b & c, "all3").when(c & ~a & ~b, "csi_all_only").when(a & c, "csi300_all").when(b & c, "csi500_all").when(a & b, "csi300_500").when(a, "csi300_only").when(b, "csi500_only").otherwise("none")
    )


def strip_grade(calmar: Column, excess: Column, dd: Column | None = None) -> Column:
    """What is left of a factor without its styles.  D: not tested; C: Calmar or annual excess not positive; B: positive, but Calmar
    below 0.30 or (where it is known) a drawdown of 20 % or worse; A: the rest."""
    deep = F.coalesce(dd <= -0.20, F.lit(False)) if dd is not None else F.lit(False)
    return F.when(calmar.isNull() | excess.isNull(), "D").when((calmar <= 0) | (excess <= 0), "C").when((calmar < 0.30) | deep, "B").otherwise("A")


def rule_quality(rows: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """Precision, recall, lift and the kill and false-kill rates of a boolean rule."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    out = rows.agg(F.count("*").alias("n"), n(p).alias("n_pred"), n(t).alias("n_true"), n(p & t).alias("n_both"), n(~p & t).alias("n_lost"))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.select(
        "n", "n_pred", "n_true", "n_both", share("n_both", "n_pred").alias("precision"), share("n_both", "n_true").alias("recall"),
        F.try_divide(share("n_both", "n_pred"), share("n_true", "n")).alias("lift"), (1 - share("n_pred", "n")).alias("kill"),
        share("n_lost", "n_true").alias("false_kill"),
    )


def _reached(x: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds ``x`` reaches, by bisection; 0 for NULL."""
    held, steps = F.array(*map(F.lit, thresholds)), F.array(*[F.lit(1 << k) for k in reversed(range(len(thresholds).bit_length()))])

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        return F.when((to <= len(thresholds)) & F.coalesce(x >= F.try_element_at(held, to), F.lit(False)), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def rule_grid(rows: DataFrame, metrics: list[str], thresholds: list[list[float]], truth: Column, both: bool = True) -> DataFrame:
    """:func:`rule_quality` for every pair of thresholds of two metrics (both reached, or either).

    Each row falls into one cell of the grid, by how many thresholds of either metric it reaches; the counts of a rule are sums over all
    cells from its own on, made by running totals along both axes.  So rows are read once, whatever the size of the grid.
    """
    xs, ys = (sorted(set(map(float, t))) for t in thresholds)
    t = F.coalesce(truth, F.lit(False))
    cells = rows.groupBy(_reached(F.col(metrics[0]), xs).alias("i"), _reached(F.col(metrics[1]), ys).alias("j")).agg(
        F.count("*").alias("n"), F.count(F.when(t, 1)).alias("t"),
    )
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k)))
    grid = rows.sparkSession.range(1).select(every(len(xs)).alias("i")).select("i", every(len(ys)).alias("j"))
    grid = grid.join(cells, ["i", "j"], "left").select("i", "j", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "t")])
    if both:
        along = lambda fixed, order: Window.partitionBy(fixed).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    else:
        along = lambda fixed, order: Window.partitionBy(fixed).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    sums = grid.withColumns({c: F.coalesce(F.sum(c).over(along("i", "j")), none) for c in ("n", "t")})
    sums = sums.withColumns({c: F.coalesce(F.sum(c).over(along("j", "i")), none) for c in ("n", "t")})
    total = cells.agg(F.coalesce(F.sum("n"), none).alias("all"), F.coalesce(F.sum("t"), none).alias("n_true"))
    sums = sums.where("i > 0 and j > 0").crossJoin(F.broadcast(total))
    hit, right = (F.col("n"), F.col("t")) if both else (F.col("all") - F.col("n"), F.col("n_true") - F.col("t"))
    at = lambda k, held: F.element_at(F.array(*map(F.lit, held)), F.col(k))
    return sums.select(
        at("i", xs).alias("x"), at("j", ys).alias("y"), hit.alias("n_pred"), F.try_divide(right, hit).alias("precision"),
        F.try_divide(right, F.col("n_true")).alias("recall"),
    )


def best_thresholds(grid: DataFrame, least_precision: float) -> DataFrame:
    """Of a :func:`rule_grid` the rule that keeps most of what is right at that precision (ties: the more precise, then the higher thresholds)."""
    fine = grid.where(F.col("precision") >= least_precision)
    return fine.agg(F.max_by(F.struct("x", "y", "n_pred", "precision", "recall"), F.struct("recall", "precision", "x", "y")).alias("m")).where("m is not null").select("m.*")


def best_per_key(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the largest score of each key (NULL scores last, ties by ``tie``)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def quota(rows: DataFrame, key: str, k: int, score: str, tie: str) -> DataFrame:
    """The first k rows of each key in order of score."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def with_reserved(rows: DataFrame, total: int, reserve: int, special: Column, score: str, tie: str) -> DataFrame:
    """``total`` rows by score, of which up to ``reserve`` (at most half) are kept for special ones, at the cost of the tail.

    Both parts are top lists, so no task sorts all rows: the best special ones, and the best of all others.
    """
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    special = F.coalesce(special, F.lit(False))
    kept = rows.where(special).orderBy(*order).limit(min(reserve, total // 2))
    rest = rows.join(kept.select(tie), tie, "left_anti").orderBy(*order).limit(total)
    both = kept.withColumn("__held", F.lit(0)).unionByName(rest.withColumn("__held", F.lit(1)))
    out = both.orderBy("__held", *order).limit(total).withColumn("special", special)
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("__held")

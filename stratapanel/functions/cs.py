"""Operators across symbols, per date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .ts import SYM, T


def section(*more: str):
    return Window.partitionBy(T, *more)


def count_of(x: Column, *more: str) -> Column:
    return F.count(x).over(section(*more))


def average_rank(x: Column, *more: str) -> Column:
    """1-based rank in which ties share their average; NULL for NULL."""
    order = section(*more).orderBy(x.asc_nulls_last())
    same = F.count(F.lit(1)).over(Window.partitionBy(T, *more, x))
    return F.when(x.isNotNull(), F.rank().over(order) + (same - 1) / 2)


def cs_rank(x: Column, *more: str) -> Column:
    """Average-tie percentile rank in (0, 1]."""
    return average_rank(x, *more) / count_of(x, *more)


def cs_demean(x: Column, *more: str) -> Column:
    return x - F.avg(x).over(section(*more))


def cs_scale(x: Column) -> Column:
    return (cs_rank(x) - 0.5) * 2


def cs_zscore(x: Column) -> Column:
    return (x - F.avg(x).over(section())) / (F.stddev_samp(x).over(section()) + 1e-12)


def ordinal_rank(x: Column, *more: str) -> Column:
    """0 .. 1 by value, ties by symbol."""
    order = section(*more).orderBy(x.asc_nulls_last(), F.col(SYM))
    return F.when(x.isNotNull(), (F.row_number().over(order) - 1) / F.greatest(count_of(x, *more) - 1, F.lit(1)))


def place(x: Column, *more: str) -> Column:
    """1-based place by value ascending, ties by symbol."""
    return F.when(x.isNotNull(), F.row_number().over(section(*more).orderBy(x.asc_nulls_last(), F.col(SYM))))


def bucket_qcut(x: Column, q: int = 10) -> Column:
    """0 (low) .. q - 1 (high): equal-count bins of the ranks, edges at (n - 1) k / q."""
    n = count_of(x)
    raw = F.ceil((place(x) - 1) * q / F.greatest(n - 1, F.lit(1))) - 1
    return F.when(x.isNotNull(), F.greatest(raw, F.lit(0))).cast("int")


def bucket_top(rank: Column, q: int = 10) -> Column:
    """0 is the top: min(floor((1 - r) q), q - 1)."""
    return F.when(rank.isNotNull(), F.least(F.floor((1 - rank) * q), F.lit(q - 1))).cast("int")


def bucket_ascending(pct: Column, q: int = 10) -> Column:
    return F.when(pct.isNotNull(), F.least(F.greatest(F.floor(pct * q), F.lit(0)), F.lit(q - 1))).cast("int")


def residual_one(y: Column, z: Column, *more: str) -> Column:
    """What a regression of y on [1, z] leaves, per date; y itself where z doesn't vary."""
    both = y.isNotNull() & z.isNotNull()
    a, b = F.when(both, y), F.when(both, z)
    over = section(*more)
    var = F.var_pop(b).over(over)
    beta = F.when(var > 1e-12, F.try_divide(F.covar_pop(a, b).over(over), var)).otherwise(0.0)
    return F.when(both, y - F.avg(a).over(over) - beta * (z - F.avg(b).over(over)))


def residual_two(y: Column, z1: Column, z2: Column, *more: str) -> Column:
    """What a regression of y on [1, z1, z2] leaves, per date, by the 2 x 2 normal equations; NULL where they are singular."""
    all_ = y.isNotNull() & z1.isNotNull() & z2.isNotNull()
    a, b, c = (F.when(all_, v) for v in (y, z1, z2))
    over = section(*more)
    s11, s22, s12 = F.var_pop(b).over(over), F.var_pop(c).over(over), F.covar_pop(b, c).over(over)
    s1, s2 = F.covar_pop(a, b).over(over), F.covar_pop(a, c).over(over)
    det = s11 * s22 - s12 * s12
    b1, b2 = F.try_divide(s1 * s22 - s2 * s12, det), F.try_divide(s2 * s11 - s1 * s12, det)
    fit = F.avg(a).over(over) + b1 * (z1 - F.avg(b).over(over)) + b2 * (z2 - F.avg(c).over(over))
    return F.when(all_ & (det > 1e-14), y - fit)

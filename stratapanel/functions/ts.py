"""Operators along time, per symbol, over row frames of the dense grid (calendar x symbols, missing cells are NULL rows).

Columns over windows read every row of their window, which is well for narrow ones; :mod:`scan` has them for windows of any width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYM, T = "sym", "t"
FLAT = 1e-12


def line():
    return Window.partitionBy(SYM).orderBy(T)


def frame(w: int):
    return line().rowsBetween(-(w - 1), 0)


def least_obs(w: int) -> int:
    return max(2, w // 2)


def _enough(x: Column, w: int, value: Column) -> Column:
    return F.when(F.count(x).over(frame(w)) >= least_obs(w), value)


def ts_mean(x: Column, w: int) -> Column:
    return _enough(x, w, F.avg(x).over(frame(w)))


def ts_std(x: Column, w: int) -> Column:
    """Population standard deviation."""
    return _enough(x, w, F.stddev_pop(x).over(frame(w)))


def ts_std_samp(x: Column, w: int) -> Column:
    return _enough(x, w, F.stddev_samp(x).over(frame(w)))


def ts_sum(x: Column, w: int) -> Column:
    return _enough(x, w, F.sum(x).over(frame(w)))


def ts_max(x: Column, w: int) -> Column:
    return _enough(x, w, F.max(x).over(frame(w)))


def ts_min(x: Column, w: int) -> Column:
    return _enough(x, w, F.min(x).over(frame(w)))


def ts_pos(x: Column, w: int) -> Column:
    """Where x stands between the window's minimum and maximum."""
    low, high = ts_min(x, w), ts_max(x, w)
    return (x - low) / (high - low + FLAT)


def ts_delay(x: Column, n: int) -> Column:
    return F.lag(x, n).over(line())


def ts_delta(x: Column, n: int) -> Column:
    return x - F.lag(x, n).over(line())


def fill_forward(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(line().rowsBetween(0, Window.unboundedFollowing))


def rolling(frame: DataFrame, w: int, sums: dict[str, Column], extremes: dict[str, Column] | None = None) -> DataFrame:
    """``frame`` with the sums, and the ranges (maximum - minimum), of columns over the last ``w`` rows, at a cost per row that doesn't grow with ``w``.

    The calendar is cut into blocks of ``w`` rows.  A window is the end of one block and the beginning of the next: running totals
    from the front and from the back of each block add up to it, so nothing is subtracted and no digits are lost.  Needs a dense grid.
    """
    block = F.floor(F.col(T) / w)
    front, back_ = (
        Window.partitionBy(SYM, block).orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.col(T).asc(), F.col(T).desc())
    )
    made = {f"__s_{k}": F.coalesce(c, F.lit(0.0)) for k, c in sums.items()} | {f"__x_{k}": c for k, c in (extremes or {}).items()}
    frame = frame.withColumns(made)
    kinds = [(f"__s_{k}", "s", F.sum) for k in sums] + [(f"__x_{k}", e, f) for k in extremes or {} for e, f in (("h", F.max), ("l", F.min))]
    frame = frame.withColumns(
        {f"{c}_f{e}": f(c).over(front) for c, e, f in kinds}
    ).withColumns({f"{c}_b{e}": f(c).over(back_) for c, e, f in kinds})
    spans = F.col(T) % w != w - 1  # else the window is the block itself
    before = {f"{c}_{e}": F.when(spans, F.lag(f"{c}_b{e}", w - 1).over(line())) for c, e, _ in kinds}
    frame = frame.withColumns(before)
    whole = lambda c, e: F.col(f"{c}_f{e}") + F.coalesce(F.col(f"{c}_{e}"), F.lit(0.0)) if e == "s" else (F.greatest if e == "h" else F.least)(f"{c}_f{e}", f"{c}_{e}")
    out = {k: whole(f"__s_{k}", "s") for k in sums} | {k: whole(f"__x_{k}", "h") - whole(f"__x_{k}", "l") for k in extremes or {}}
    frame = frame.withColumns(out)
    return frame.drop(*made, *[f"{c}_{p}{e}" for c, e, _ in kinds for p in ("f", "b", "")])


def _anchored(x: Column) -> Column:
    """``x`` less the symbol's first value, which keeps the digits of sums of squares."""
    return x - F.first(x, ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def regressions(frame: DataFrame, x: str, w: int, out: dict[str, str]) -> DataFrame:
    """Regression of ``x`` on position over full windows of ``w`` rows: ``out`` names the columns for ``slope``, ``rsqr`` (NULL for a
    flat window) and ``resi`` (the last point less the fitted line).  All three share one set of sums."""
    frame = frame.withColumn("__y", _anchored(F.col(x)))
    y, at = F.col("__y"), F.col(T) % w
    # positions are counted within blocks: rows of the block before belong w places lower
    early = F.when(F.floor(F.col(T) / w) % 2 == 0, y)
    sums = {"__n": F.when(y.isNotNull(), 1.0), "__sy": y, "__syy": y * y, "__sty": y * at, "__even": early}
    frame = rolling(frame, w, sums, {"__range": y})
    before = F.when(F.floor(F.col(T) / w) % 2 == 0, F.col("__sy") - F.col("__even")).otherwise(F.col("__even"))
    n, mean = float(w), F.col("__sy") / w
    sty = F.col("__sty") - w * before - (at - (w - 1) / 2.0) * F.col("__sy")  # sum of (position - mean position) * y
    stt = n * (n * n - 1) / 12
    slope, total = sty / stt, F.col("__syy") - F.col("__sy") * mean
    full = F.col("__n") == w
    made = {
        "slope": F.when(full, slope),
        "rsqr": F.when(
            full & (F.col("__range") > 0) & (total > FLAT), F.least(F.greatest(sty * sty / (stt * total), F.lit(0.0)), F.lit(1.0)),
        ),
        "resi": F.when(full, y - (mean + slope * (w - 1) / 2.0)),
    }
    frame = frame.withColumns({name: made[kind] for kind, name in out.items()})
    return frame.drop("__y", "__range", *sums)


def correlations(frame: DataFrame, x: str, y: str, w: int, out: str) -> DataFrame:
    """Population correlation over the last ``w`` rows of the pairs that are both present; at least max(3, w / 2) pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    frame = frame.withColumns({"__a": _anchored(F.when(both, F.col(x))), "__b": _anchored(F.when(both, F.col(y)))})
    a, b = F.col("__a"), F.col("__b")
    sums = {"__n": F.when(both, 1.0), "__sa": a, "__sb": b, "__saa": a * a, "__sbb": b * b, "__sab": a * b}
    frame = rolling(frame, w, sums, {"__ra": a, "__rb": b})
    n = F.col("__n")
    cov = lambda p, q, pq: F.try_divide(F.col(pq) - F.try_divide(F.col(p) * F.col(q), n), n)
    va, vb = (F.greatest(cov(f"__s{k}", f"__s{k}", f"__s{k}{k}"), F.lit(0.0)) for k in "ab")
    den = F.sqrt(va * vb)
    fine = (n >= max(3, w // 2)) & (F.col("__ra") > 0) & (F.col("__rb") > 0) & (den > FLAT)
    frame = frame.withColumn(out, F.when(fine, F.try_divide(cov("__sa", "__sb", "__sab"), den)))
    return frame.drop("__a", "__b", "__ra", "__rb", *sums)

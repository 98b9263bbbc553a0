"""Panels, leaves and the operators along time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import ts
from ..functions.scalar import ieee_div, rounded
from ..functions.scan import Scan, scan, scans
from ..functions.ts import SYM, T
from ..sources import panels
from .base import LEAVES, P1, P2, expressions, line, panel_of, r


def _enough(value: str, w: int, x: str) -> str:
    return f"CASE WHEN count({x}) {line(w)} >= {max(2, w // 2)} THEN {value} END"


def _full(value: str, w: int, x: str) -> str:
    return f"CASE WHEN count({x}) {line(w)} = {w} THEN {value} END"


def _simple(prefix: str, fn: str, windows: tuple[int, ...], x: str = "ln_volume", kind: str = "P2"):
    texts = {f"{prefix}{w}": f"{prefix}{w}({x})" for w in windows}
    return expressions(kind, texts, {f"{prefix}{w}": _enough(f"{fn}({x}) {line(w)}", w, x) for w in windows}, leaves=True)


def _rank_sql(w: int, x: str) -> str:
    seen = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {line(w)}"
    return f"CASE WHEN {x} IS NOT NULL AND len({seen}) >= {max(2, w // 2)} THEN len(list_filter({seen}, lambda v: v < {x}))::DOUBLE / greatest(len({seen}) - 1, 1) END"


def _moment(w: int, x: str, kurt: bool) -> str:
    m, m2 = f"avg({x}) {line(w)}", f"avg({x} * {x}) {line(w)}"
    m3, m4 = f"avg({x} * {x} * {x}) {line(w)}", f"avg({x} * {x} * {x} * {x}) {line(w)}"
    var = f"({m2} - {m} * {m})"
    third = f"({m3} - 3 * {m} * {m2} + 2 * {m} * {m} * {m})"
    fourth = f"({m4} - 4 * {m} * {m3} + 6 * {m} * {m} * {m2} - 3 * {m} * {m} * {m} * {m})"
    value = f"{fourth} / ({var} * {var}) - 3" if kurt else f"{third} / pow({var}, 1.5)"
    return _full(f"CASE WHEN var_pop({x}) {line(w)} > 1e-12 THEN {value} END", w, x)


def _corr_sql(w: int, x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    den = f"sqrt(var_pop({a}) {line(w)} * var_pop({b}) {line(w)})"
    return f"CASE WHEN count({a}) {line(w)} >= {max(3, w // 2)} AND {den} > 1e-12 THEN covar_pop({a}, {b}) {line(w)} / {den} END"


def _slope(w: int, x: str) -> str:
    return f"regr_slope({x}, t) {line(w)}"


def _ema_sql(windows: tuple[int, ...], x: str) -> str:
    state = ", ".join(f"CAST({x} AS DOUBLE) AS e{w}" for w in windows)
    step = ", ".join(
        f"CASE WHEN l.{x} IS NULL THEN s.e{w} WHEN s.e{w} IS NULL THEN l.{x} ELSE {2.0 / (w + 1)!r} * l.{x} + {1 - 2.0 / (w + 1)!r} * s.e{w} END" for w in windows
    )
    out = ", ".join(f"{r(f'CASE WHEN n >= {w} THEN e{w} END')} AS ema{w}" for w in windows)
    return f"""WITH RECURSIVE {P2}, {LEAVES}, walk AS (
  SELECT sym, t, {state}, CAST(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n FROM leaves WHERE t = 0
  UNION ALL
  SELECT l.sym, l.t, {step}, s.n + CASE WHEN l.{x} IS NULL THEN 0 ELSE 1 END FROM walk s JOIN leaves l ON l.sym = s.sym AND l.t = s.t + 1
) SELECT sym, CAST(t AS BIGINT) AS t, {out} FROM walk"""


def _panel(kind: str):
    cols = ("close", "open", "high", "low", "volume", "turnover", "mktcap")

    def run(spark, sf_dir):
        return panel_of(kind)(spark, sf_dir).select(
            SYM, F.col(T).cast("long").alias(T), "date", *[rounded(F.col(c), 3).alias(c) for c in cols],
        )

    return run, f"WITH {P1 if kind == 'P1' else P2}\nSELECT sym, CAST(t AS BIGINT) AS t, date, {', '.join(f'{r(c, 3)} AS {c}' for c in cols)} FROM panel"


def _leaves(kind: str):
    def run(spark, sf_dir):
        frame = panels.with_leaves(panel_of(kind)(spark, sf_dir), ieee_div)
        return frame.select(SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(c)).alias(c) for c in panels.DERIVED])

    return run, f"WITH {P1 if kind == 'P1' else P2}, {LEAVES}\nSELECT sym, CAST(t AS BIGINT) AS t, {', '.join(f'{r(c)} AS {c}' for c in panels.DERIVED)} FROM leaves"


def _extra(cols: Callable[[], dict], sql: dict):
    """Operators along time that expressions don't use; columns are built when the query runs, as they need a session."""

    def run(spark, sf_dir):
        frame = panels.with_leaves(panels.lineitem_panel(spark, sf_dir))
        return frame.select(SYM, F.col(T).cast("long").alias(T), *[rounded(c).alias(k) for k, c in cols().items()])

    return run, f"WITH {P2}, {LEAVES}\nSELECT sym, CAST(t AS BIGINT) AS t, {', '.join(f'{r(v)} AS {k}' for k, v in sql.items())} FROM leaves"


def _scanned(wanted: dict[str, Scan], sql: dict[str, str]):
    """Operators of the scan that expressions don't use."""

    def run(spark, sf_dir):
        frame = scans(panels.with_leaves(panels.lineitem_panel(spark, sf_dir)), wanted)
        return frame.select(SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(c)).alias(c) for c in wanted])

    return run, f"WITH {P2}, {LEAVES}\nSELECT sym, CAST(t AS BIGINT) AS t, {', '.join(f'{r(v)} AS {k}' for k, v in sql.items())} FROM leaves"


def _wide():
    """The widest windows, over days: the months are too few for them."""
    x = "ln_volume"
    texts = {c: f"{c}({x})" for c in ("ts_mean200", "ts_std200", "ts_rank200", "ts_delta120", "ts_max100", "ts_min100", "ts_sum100")}
    sql = {
        "ts_mean200": _enough(f"avg({x}) {line(200)}", 200, x), "ts_std200": _enough(f"stddev_pop({x}) {line(200)}", 200, x),
        "ts_rank200": _rank_sql(200, x), "ts_delta120": f"{x} - lag({x}, 120) OVER (PARTITION BY sym ORDER BY t)",
        "ts_max100": _enough(f"max({x}) {line(100)}", 100, x), "ts_min100": _enough(f"min({x}) {line(100)}", 100, x),
        "ts_sum100": _enough(f"sum({x}) {line(100)}", 100, x), "corr200": _corr_sql(200, x, "intraday"),
    }
    return expressions("P3", texts | {"corr200": f"corr200({x}, intraday)"}, sql, leaves=True)


_RUN = "OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_seen = f"list(turn_ratio) FILTER (WHERE turn_ratio IS NOT NULL) {line(36)}"

QUERIES = {
    "panel_monthly": _panel("P2"),
    "panel_daily": _panel("P1"),
    "leaves_monthly": _leaves("P2"),
    "leaves_daily": _leaves("P1"),
    "ts_mean": _simple("ts_mean", "avg", (5, 10, 20, 60, 100, 120, 150)),
    "ts_std": _simple("ts_std", "stddev_pop", (20, 60, 100, 150)),
    "ts_sum": _simple("ts_sum", "sum", (20, 100)),
    "ts_max": _simple("ts_max", "max", (20, 100)),
    "ts_min": _simple("ts_min", "min", (20, 100)),
    "ts_rank": expressions(
        "P2", {f"ts_rank{w}": f"ts_rank{w}(ret)" for w in (10, 20, 60, 100)},
        {f"ts_rank{w}": _rank_sql(w, "ret") for w in (10, 20, 60, 100)}, leaves=True,
    ),
    "ts_shift": expressions(
        "P2", {"ts_delay1": "ts_delay1(ln_volume)", **{f"ts_delta{w}": f"ts_delta{w}(ln_volume)" for w in (5, 10, 20, 60)}},
        {
            "ts_delay1": "lag(ln_volume, 1) OVER (PARTITION BY sym ORDER BY t)",
            **{f"ts_delta{w}": f"ln_volume - lag(ln_volume, {w}) OVER (PARTITION BY sym ORDER BY t)" for w in (5, 10, 20, 60)},
        }, leaves=True,
    ),
    "ts_regression": expressions(
        "P2", {f"ts_{k}{w}": f"ts_{k}{w}(ln_mktcap)" for k in ("slope", "rsqr", "resi") for w in (5, 10, 20, 60)},
        {
            **{f"ts_slope{w}": _full(_slope(w, "ln_mktcap"), w, "ln_mktcap") for w in (5, 10, 20, 60)},
            **{
                f"ts_rsqr{w}": _full(
                    f"CASE WHEN var_pop(ln_mktcap) {line(w)} * {w} > 1e-12 THEN regr_r2(ln_mktcap, t) {line(w)} END", w, "ln_mktcap",
                ) for w in (5, 10, 20, 60)
            },
            **{
                f"ts_resi{w}": _full(
                    f"ln_mktcap - (regr_intercept(ln_mktcap, t) {line(w)} + {_slope(w, 'ln_mktcap')} * t)", w, "ln_mktcap",
                ) for w in (5, 10, 20, 60)
            },
        }, leaves=True,
    ),
    "ts_moments": expressions(
        "P2", {"ts_skew20": "ts_skew20(ret)", "ts_kurt20": "ts_kurt20(ret)", "ts_skew60": "ts_skew60(ret)", "ts_kurt60": "ts_kurt60(ret)"},
        {
            "ts_skew20": _moment(20, "ret", False), "ts_kurt20": _moment(20, "ret", True), "ts_skew60": _moment(60, "ret", False),
            "ts_kurt60": _moment(60, "ret", True),
        }, leaves=True,
    ),
    "ts_corr": expressions(
        "P2", {f"corr{w}": f"corr{w}(ret, ln_volume)" for w in (20, 60, 100)},
        {f"corr{w}": _corr_sql(w, "ret", "ln_volume") for w in (20, 60, 100)}, leaves=True,
    ),
    "ts_ema": (
        expressions("P2", {f"ema{w}": f"ema{w}(intraday)" for w in (5, 12, 20, 26, 60)}, {}, leaves=True)[0],
        _ema_sql((5, 12, 20, 26, 60), "intraday"),
    ),
    "ts_position": _extra(
        lambda: {"ts_pos": ts.ts_pos(F.col("ln_volume"), 20), "ts_std_samp": ts.ts_std_samp(F.col("ret"), 20)},
        {
            "ts_pos": f"({'ln_volume'} - {_enough(f'min(ln_volume) {line(20)}', 20, 'ln_volume')}) / ({_enough(f'max(ln_volume) {line(20)}', 20, 'ln_volume')} - {_enough(f'min(ln_volume) {line(20)}', 20, 'ln_volume')} + 1e-12)",
            "ts_std_samp": _enough(f"stddev_samp(ret) {line(20)}", 20, "ret"),
        },
    ),
    "fill": _extra(
        lambda: {"forward": ts.fill_forward(F.col("ret")), "backward": ts.fill_backward(F.col("ret"))},
        {
            "forward": f"last_value(ret IGNORE NULLS) {_RUN}",
            "backward": "first_value(ret IGNORE NULLS) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
        },
    ),
    "rolling_pct_rank": _scanned(
        {"pct": scan("pct_rank", "turn_ratio", 36, 12)},
        {"pct": f"CASE WHEN turn_ratio IS NOT NULL AND len({_seen}) >= 12 THEN (len(list_filter({_seen}, lambda v: v < turn_ratio)) + (len(list_filter({_seen}, lambda v: v = turn_ratio)) + 1) / 2.0) / len({_seen}) END"},
    ),
    "wide_windows": _wide(),
}

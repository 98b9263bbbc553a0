"""Element-wise operators, operators across symbols, neutralisation and buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import cs
from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..operators import evaluation as ev
from ..plans.compiler import evaluate
from ..plans.expr import parse
from ..sources import panels
from .base import LEAVES, P2, expressions, line, r

F_TEXT, F_SQL = "ts_mean5(intraday)", f"CASE WHEN count(intraday) {line(5)} >= 2 THEN avg(intraday) {line(5)} END"


def base_rows(spark, sf_dir, fwd: int = 5, extra: dict[str, str] | None = None):
    """(sym, t, date, industry, pool, prices, f, r): a factor and the return of buying at the next close and holding ``fwd`` rows."""
    keep = ("date", "industry", "pool", "close", "mktcap", "turnover", "volume", "ln_mktcap", "ln_volume", "turn_ratio")
    panel = panels.with_leaves(panels.lineitem_panel(spark, sf_dir))
    made = evaluate(panel, {"f": parse(F_TEXT)} | {k: parse(v) for k, v in (extra or {}).items()}, keep)
    return made.withColumn("r", panels.forward_return(fwd))


def base_sql(fwd: int = 5, extra: str = "") -> str:
    lead = "OVER (PARTITION BY sym ORDER BY t)"
    return f"""WITH {P2}, {LEAVES}, base AS (
  SELECT sym, t, date, industry, pool, close, mktcap, turnover, volume, ln_mktcap, ln_volume, turn_ratio, {F_SQL} AS f, lead(close, {fwd + 1}) {lead} / lead(close, 1) {lead} - 1 AS r{extra}
  FROM leaves
)"""


def avg_rank(x: str, by: str = "t") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def ordinal(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (row_number() OVER (PARTITION BY t ORDER BY {x} NULLS LAST, sym) - 1)::DOUBLE / greatest(count({x}) OVER (PARTITION BY t) - 1, 1) END"


def place(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY {x} NULLS LAST, sym) END"


def pct(x: str) -> str:
    return f"({avg_rank(x)}) / count({x}) OVER (PARTITION BY t)"


def _columns(cols: Callable[[], dict], sql: dict, ints: tuple[str, ...] = ()):
    """Columns over the base rows; they are built when the query runs, as columns need a session."""

    def run(spark, sf_dir):
        frame = base_rows(spark, sf_dir).withColumn("pct", cs.cs_rank(F.col("f")))
        return frame.select(
            SYM, F.col(T).cast("long").alias(T), *[(c.cast("long") if k in ints else rounded(c)).alias(k) for k, c in cols().items()],
        )

    shown = ", ".join(f"{f'CAST({v} AS BIGINT)' if k in ints else r(v)} AS {k}" for k, v in sql.items())
    return run, f"{base_sql()}, ranked AS (SELECT *, {pct('f')} AS pct FROM base)\nSELECT sym, CAST(t AS BIGINT) AS t, {shown} FROM ranked"


def _neutral_two(z1: str = "ln_mktcap", z2: str = "ln_volume"):
    def run(spark, sf_dir):
        frame = ev.neutralised(base_rows(spark, sf_dir), "f", z1, z2, "neutral", least=30)
        return frame.select(SYM, F.col(T).cast("long").alias(T), rounded(F.col("neutral")).alias("neutral"))

    both = f"f IS NOT NULL AND {z1} IS NOT NULL AND {z2} IS NOT NULL"
    w = "OVER (PARTITION BY t)"
    return run, f"""{base_sql()}, s AS (
  SELECT sym, t, CASE WHEN {both} THEN f END AS a, CASE WHEN {both} THEN {z1} END AS b, CASE WHEN {both} THEN {z2} END AS c FROM base
), k AS (SELECT sym, t, count(a) {w} AS n, {ordinal('a')} AS y, {ordinal('b')} AS x1, {ordinal('c')} AS x2 FROM s),
m AS (SELECT *, var_pop(x1) {w} AS s11, var_pop(x2) {w} AS s22, covar_pop(x1, x2) {w} AS s12, covar_pop(y, x1) {w} AS s1, covar_pop(y, x2) {w} AS s2, avg(y) {w} AS my, avg(x1) {w} AS m1, avg(x2) {w} AS m2 FROM k),
e AS (
  SELECT sym, t, n, CASE WHEN y IS NOT NULL AND s11 * s22 - s12 * s12 > 1e-14 THEN
    y - (my + (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2)) END AS e FROM m
) SELECT sym, CAST(t AS BIGINT) AS t, {r(f"CASE WHEN n >= 30 THEN {ordinal('e')} END")} AS neutral FROM e"""


def _neutral_industry():
    def run(spark, sf_dir):
        rows = base_rows(spark, sf_dir).withColumn("f", F.when(F.col(T) % 7 == 0, F.col("ln_mktcap") * 2).otherwise(F.col("f")))
        frame = ev.industry_size_neutral(rows, "f", "ln_mktcap", "industry")
        return frame.select(SYM, F.col(T).cast("long").alias(T), rounded(F.col("neutral")).alias("neutral"), "degenerate")

    w, g = "OVER (PARTITION BY t)", "OVER (PARTITION BY t, g)"
    return run, f"""{base_sql()}, b AS (SELECT sym, t, coalesce(industry, -1) AS g, CASE WHEN t % 7 = 0 THEN ln_mktcap * 2 ELSE f END AS f, ln_mktcap AS z FROM base),
s AS (SELECT sym, t, g, CASE WHEN z IS NOT NULL THEN f END AS a, CASE WHEN f IS NOT NULL THEN z END AS z FROM b),
d AS (
  SELECT sym, t, stddev_pop(a) {w} AS sd, CASE WHEN count(a) {g} >= 5 THEN a - avg(a) {g} ELSE a END AS a, CASE WHEN count(a) {g} >= 5 THEN z - avg(z) {g} ELSE z END AS z FROM s
), m AS (SELECT sym, t, sd, a - CASE WHEN stddev_pop(z) {w} > 1e-12 THEN covar_pop(a, z) {w} / var_pop(z) {w} ELSE 0 END * z AS e FROM d)
SELECT sym, CAST(t AS BIGINT) AS t, {r('e')} AS neutral, quantile_cont(abs(e), 0.995) {w} <= 1e-3 * sd AS degenerate FROM m"""


def _many():
    def run(spark, sf_dir):
        rows = base_rows(spark, sf_dir)
        made = ev.many_regressor_residual(rows, "f", ["ln_mktcap", "ln_volume"], least=30)
        return made.select(SYM, F.col(T).cast("long").alias(T), rounded(F.col("residual")).alias("residual"))

    w = "OVER (PARTITION BY t)"
    return run, f"""{base_sql()}, s AS (SELECT sym, t, f AS y, ln_mktcap AS x1, ln_volume AS x2 FROM base WHERE f IS NOT NULL AND ln_mktcap IS NOT NULL AND ln_volume IS NOT NULL),
m AS (SELECT *, count(*) {w} AS n, var_pop(x1) {w} AS s11, var_pop(x2) {w} AS s22, covar_pop(x1, x2) {w} AS s12, covar_pop(y, x1) {w} AS s1, covar_pop(y, x2) {w} AS s2, avg(y) {w} AS my, avg(x1) {w} AS m1, avg(x2) {w} AS m2 FROM s)
SELECT sym, CAST(t AS BIGINT) AS t, {r("y - (my + (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2))")} AS residual FROM m WHERE n >= 30"""


def _r2():
    def run(spark, sf_dir):
        per = ev.industry_r2(base_rows(spark, sf_dir), "f", "pool")
        return per.select(F.col(T).cast("long").alias(T), "n", rounded(F.col("r2")).alias("r2"))

    return run, f"""{base_sql()}, h AS (SELECT t, f, avg(f) OVER (PARTITION BY t, pool) AS m FROM base WHERE f IS NOT NULL)
SELECT CAST(t AS BIGINT) AS t, count(*) AS n, {r("CASE WHEN var_pop(f) > 1e-12 THEN 1 - avg((f - m) * (f - m)) / var_pop(f) END")} AS r2 FROM h GROUP BY t"""


_n = "count(f) OVER (PARTITION BY t)"
LADDER = {"none": [], "size": ["ln_mktcap"], "volume": ["ln_volume"], "turnover": ["turn_ratio"], "size_volume": ["ln_mktcap", "ln_volume"], "size_turnover": ["ln_mktcap", "turn_ratio"]}


def style_ladder(spark, sf_dir):
    out = ev.style_ladder(base_rows(spark, sf_dir), "f", LADDER, least=30)
    return out.select("model", "days", rounded(F.col("ic")).alias("ic"), rounded(F.col("excess")).alias("excess"))


def left_over(held: list[str]) -> str:
    """What a regression of y on none, one or two columns leaves, per date."""
    w = "OVER (PARTITION BY t)"
    if not held:
        return "y"
    if len(held) == 1:
        x = held[0]
        return f"y - avg(y) {w} - CASE WHEN var_pop({x}) {w} > 1e-12 THEN covar_pop(y, {x}) {w} / var_pop({x}) {w} ELSE 0 END * ({x} - avg({x}) {w})"
    a, b = held
    s = {k: f"{f}({', '.join(v)}) {w}" for k, f, v in (("aa", "var_pop", [a]), ("bb", "var_pop", [b]), ("ab", "covar_pop", [a, b]), ("ya", "covar_pop", ["y", a]), ("yb", "covar_pop", ["y", b]))}
    det = f"({s['aa']} * {s['bb']} - {s['ab']} * {s['ab']})"
    first, second = f"({s['ya']} * {s['bb']} - {s['yb']} * {s['ab']}) / {det}", f"({s['yb']} * {s['aa']} - {s['ya']} * {s['ab']}) / {det}"
    return f"y - avg(y) {w} - {first} * ({a} - avg({a}) {w}) - {second} * ({b} - avg({b}) {w})"


def _ladder_sql() -> str:
    w = "OVER (PARTITION BY t)"
    parts = []
    for name, held in LADDER.items():
        left = left_over(held)
        given = "".join(f" AND {c} IS NOT NULL" for c in held)
        parts.append(f"SELECT '{name}' AS model, sym, t, r, {left} AS v, count(*) {w} AS m FROM q WHERE y IS NOT NULL{given}")
    return f"""{base_sql()}, q AS (SELECT sym, t, r, {ordinal('f')} AS y, {', '.join(f'{ordinal(c)} AS {c}' for c in ('ln_mktcap', 'ln_volume', 'turn_ratio'))} FROM base WHERE t % 5 = 0),
l AS ({' UNION ALL '.join(parts)}), k AS (SELECT model, sym, t, r, v, {avg_rank('v', 'model, t')} AS a, {avg_rank('r', 'model, t')} AS b, count(*) OVER (PARTITION BY model, t) AS n, row_number() OVER (PARTITION BY model, t ORDER BY v DESC, sym) AS place FROM l WHERE m >= 30 AND v IS NOT NULL AND r IS NOT NULL),
d AS (SELECT model, t, corr(a, b) AS ic, avg(CASE WHEN place <= greatest(floor(n * 0.1), 1) THEN r END) - avg(r) AS excess FROM k WHERE n >= 30 GROUP BY model, t)
SELECT model, count(*) AS days, {r('avg(ic)')} AS ic, {r('avg(excess)')} AS excess FROM d GROUP BY model"""


QUERIES = {
    "style_ladder": (style_ladder, _ladder_sql()),
    "elementwise": expressions(
        "P2",
        {
            "log_": "log(volume)", "abs_": "abs(intraday)", "neg_": "neg(intraday)", "sign_": "sign(intraday)", "add_": "add(open, close)", "sub_": "sub(high, low)", "mul_": "mul(intraday, overnight)",
            "div_": "div(turnover, volume)", "min_": "min(open, close)", "max_": "max(open, close)",
        },
        {
            "log_": "ln_volume", "abs_": "abs(intraday)", "neg_": "-intraday", "sign_": "sign(intraday)", "add_": "open + close", "sub_": "high - low", "mul_": "intraday * overnight",
            "div_": "CASE WHEN abs(volume) > 1e-9 THEN turnover / volume END", "min_": "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) END", "max_": "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END",
        }, leaves=True,
    ),
    "cs_operators": expressions(
        "P2", {"cs_rank": "cs_rank(ln_volume)", "cs_demean": "cs_demean(ln_volume)", "cs_scale": "cs_scale(intraday)"},
        {
            "cs_rank": pct("ln_volume"), "cs_demean": "ln_volume - avg(ln_volume) OVER (PARTITION BY t)",
            "cs_scale": f"({pct('intraday')} - 0.5) * 2",
        }, leaves=True,
    ),
    "cs_extra": _columns(
        lambda: {
            "zscore": cs.cs_zscore(F.col("f")), "ordinal": cs.ordinal_rank(F.col("f")),
            "rank_in_industry": cs.cs_rank(F.col("f"), "industry"),
        },
        {
            "zscore": "(f - avg(f) OVER (PARTITION BY t)) / (stddev_samp(f) OVER (PARTITION BY t) + 1e-12)", "ordinal": ordinal("f"),
            "rank_in_industry": f"({avg_rank('f', 't, industry')}) / count(f) OVER (PARTITION BY t, industry)",
        },
    ),
    "buckets": _columns(
        lambda: {
            "qcut": cs.bucket_qcut(F.col("f")), "top_first": cs.bucket_top(F.col("pct")), "ascending": cs.bucket_ascending(F.col("pct")),
            "top_decile": (F.col("pct") > 0.9).cast("int"),
            "quantile_code": F.when(
                F.col("f").isNotNull() & (cs.count_of(F.col("f")) >= 2),
                F.least(F.floor((cs.place(F.col("f")) - 1) * 256 / cs.count_of(F.col("f"))), F.lit(255)),
            ),
        },
        {
            "qcut": f"CASE WHEN f IS NOT NULL THEN greatest(ceil(({place('f')} - 1) * 10 / greatest({_n} - 1, 1)::DOUBLE) - 1, 0) END", "top_first": "CASE WHEN floor((1 - pct) * 10) > 9 THEN 9 ELSE floor((1 - pct) * 10) END",
            "ascending": "CASE WHEN pct * 10 >= 10 THEN 9 WHEN pct * 10 < 0 THEN 0 ELSE floor(pct * 10) END", "top_decile": "CASE WHEN pct IS NULL THEN NULL WHEN pct > 0.9 THEN 1 ELSE 0 END",
            "quantile_code": f"CASE WHEN f IS NOT NULL AND {_n} >= 2 THEN least(floor(({place('f')} - 1) * 256 / {_n}::DOUBLE), 255) END",
        },
        ints=("qcut", "top_first", "ascending", "top_decile", "quantile_code"),
    ),
    "neutralise_one": _columns(
        lambda: {"residual": cs.residual_one(F.col("f"), F.col("ln_mktcap"))},
        {"residual": """CASE WHEN f IS NOT NULL AND ln_mktcap IS NOT NULL THEN f - avg(CASE WHEN ln_mktcap IS NOT NULL THEN f END) OVER (PARTITION BY t)
  - CASE WHEN var_pop(CASE WHEN f IS NOT NULL THEN ln_mktcap END) OVER (PARTITION BY t) > 1e-12 THEN regr_slope(f, ln_mktcap) OVER (PARTITION BY t) ELSE 0 END * (ln_mktcap - avg(CASE WHEN f IS NOT NULL THEN ln_mktcap END) OVER (PARTITION BY t)) END"""},
    ),
    "neutral_rank": _neutral_two(),
    "neutralise_industry_size": _neutral_industry(),
    "neutralise_many": _many(),
    "industry_r2": _r2(),
}

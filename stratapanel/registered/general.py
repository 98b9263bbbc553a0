"""Gates, correlation, combination, point-in-time joins, aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cs, scalar
from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..operators import combination as cb
from ..operators import control
from ..operators import evaluation as ev
from ..operators import reports as rp
from ..plans.compiler import evaluate
from ..plans.expr import parse
from ..sources import panels
from .across import base_rows, base_sql, ordinal, pct
from .base import LEAVES, P2, r
from .base import line as over

_LINE = "OVER (PARTITION BY sym ORDER BY t)"


def _returns(spark, sf_dir):
    return panels.with_leaves(panels.lineitem_panel(spark, sf_dir))


def supplier_metrics(spark, sf_dir):
    """A table of figures per supplier, for gates and quotas."""
    rows = _returns(spark, sf_dir).withColumn("last", F.max(T).over(Window.partitionBy(SYM)))
    rows = rows.withColumn(
        "part", F.when(F.col("ret").isNotNull(), F.ntile(3).over(Window.partitionBy(SYM, F.col("ret").isNull()).orderBy(T))),
    )
    gain = lambda k: F.sum(F.when(F.col("part") == k, F.log1p("ret")))
    out = rows.groupBy(SYM, "industry", "pool").agg(
        F.avg("intraday").alias("ic"), F.avg(
            F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("int"))
        ).alias("ic_win"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("calmar"),
        F.avg(
            F.when(F.col(T) > F.col("last") - 13, F.col("ret"))
        ).alias("last_yr"), F.count(F.when(F.col("ret") < -0.8, 1)).alias("bad_years"), F.min("intraday").alias("dd"),
        F.avg(F.when(F.col(T) % 2 == 0, F.col("intraday"))).alias("cal300"), F.avg(F.when(F.col(T) < 3, F.col("intraday"))).alias("cal500"),
        F.count("ret").alias("periods"), sum(
            (F.coalesce(gain(k) > 0, F.lit(False)).cast("int") for k in (2, 3)), F.coalesce(gain(1) > 0, F.lit(False)).cast("int"),
        ).alias("positive"),
    )
    return out


_METRICS = f"""WITH {P2}, {LEAVES}, metrics AS (
  SELECT sym, industry, pool, avg(intraday) AS ic, avg(CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END) AS ic_win, avg(ret) / stddev_samp(ret) AS calmar,
         avg(CASE WHEN t > (SELECT max(t) FROM panel) - 13 THEN ret END) AS last_yr, count(CASE WHEN ret < -0.8 THEN 1 END) AS bad_years, min(intraday) AS dd,
         avg(CASE WHEN t % 2 = 0 THEN intraday END) AS cal300, avg(CASE WHEN t < 3 THEN intraday END) AS cal500
  FROM leaves GROUP BY ALL
)"""

_POSITIVE = """, cuts AS (SELECT sym, ret, row_number() OVER (PARTITION BY sym ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY sym) AS n FROM leaves WHERE ret IS NOT NULL),
parts AS (SELECT sym, n, CASE WHEN i < (n // 3 + 1) * (n % 3) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n // 3 + 1) * (n % 3)) // greatest(n // 3, 1) END AS part, ret FROM cuts),
held AS (SELECT sym, any_value(n) AS n, count(*) FILTER (WHERE gain > 1) AS positive FROM (SELECT sym, n, part, product(1 + ret) AS gain FROM parts GROUP BY ALL) GROUP BY sym)"""


def gates(spark, sf_dir):
    m = supplier_metrics(spark, sf_dir)
    a, b, c = F.col("cal300") >= 0.3, F.col("cal500") >= 0.3, F.col("calmar") >= 0.35
    any_, all_ = control.pool_gate([F.col("cal300"), F.col("cal500")], 0.4), control.pool_gate(
        [F.col("cal300"), F.col("cal500")], 0.2, "all",
    )
    score = lambda mode: rounded(control.first_score(mode, F.col("ic_win"), F.col("calmar"), F.col("cal300"), F.col("ic"), F.col("cal500"))).alias(f"score_{mode}")
    parts = control.segments_hold(F.col("positive"), F.col("periods"), least=24)
    return m.select(
        SYM, control.rule(
            "calmar >= 0.35 and ic > 0.2 and last_yr > 0"
        ).alias("rule"), control.passes(0.02, 0.4, 0.3).alias("passes"), any_.alias("any_pool"), all_.alias("all_pools"),
        control.combined(control.passes(0.02, 0.4, 0.2), c, any_, parts).alias("both_gates"), control.combined(
            control.passes(0.02, 0.4, 0.2), c, any_, parts, either=True,
        ).alias("either_gate"),
        control.combined(
            control.passes(0.02, 0.4, 0.2), c, any_, parts, pool_on=False,
        ).alias("whole_gate"), control.pool_tag(a, b, c).alias("tag"),
        control.strip_grade(
            F.col("calmar") - 0.1, F.col("last_yr"), F.col("dd") + 0.7,
        ).alias("grade"), control.strip_grade(F.col("calmar") - 0.1, F.col("last_yr")).alias("grade_without_dd"), parts.alias("segments"),
        control.stripped_channel(
            F.col("ic"), F.col("calmar"), F.col("last_yr"), F.col("ic_win"), F.col("cal300"), (0.02, 0.3, 0.03, 0.4), 0.5,
        ).alias("stripped_channel"),
        control.either_horizon(control.passes(0.02, 0.4, 0.3), c).alias("either_horizon"), *[
            score(mode) for mode in ("old", "new", "ic_n", "mono_n")
        ],
    )


_base = "coalesce(abs(ic) >= 0.02 AND ic_win >= 0.4 AND calmar >= 0.2 AND last_yr > 0 AND bad_years <= 1, false)"
_unit = lambda x: f"CASE WHEN {x} IS NULL OR {x} < 0 THEN 0 WHEN {x} > 1 THEN 1 ELSE {x} END"
_GATES = f"""{_METRICS}{_POSITIVE}, f AS (
  SELECT m.*, coalesce(cal300 >= 0.3, false) AS a, coalesce(cal500 >= 0.3, false) AS b, coalesce(calmar >= 0.35, false) AS c, CASE WHEN coalesce(n, 0) < 72 THEN true ELSE positive >= 2 END AS seg, {_base} AS base,
         CASE WHEN cal300 >= 0.4 OR cal500 >= 0.4 THEN true WHEN cal300 IS NOT NULL OR cal500 IS NOT NULL THEN false END AS any_pool,
         CASE WHEN cal300 < 0.2 OR cal500 < 0.2 THEN false WHEN cal300 IS NOT NULL OR cal500 IS NOT NULL THEN true END AS all_pools
  FROM metrics m LEFT JOIN held h ON h.sym = m.sym
) SELECT sym, coalesce(calmar >= 0.35, false) AND coalesce(ic > 0.2, false) AND coalesce(last_yr > 0, false) AS rule, abs(ic) >= 0.02 AND ic_win >= 0.4 AND calmar >= 0.3 AND last_yr > 0 AND bad_years <= 1 AS passes, any_pool, all_pools,
  base AND (CASE WHEN any_pool IS NULL THEN c ELSE c AND any_pool END) AND seg AS both_gates, base AND (CASE WHEN any_pool IS NULL THEN c ELSE c OR any_pool END) AND seg AS either_gate, base AND c AND seg AS whole_gate,
  CASE WHEN a AND b AND c THEN 'all3' WHEN c AND NOT a AND NOT b THEN 'csi_all_only' WHEN a AND c THEN 'csi300_all' WHEN b AND c THEN 'csi500_all' WHEN a AND b THEN 'csi300_500' WHEN a THEN 'csi300_only' WHEN b THEN 'csi500_only' ELSE 'none' END AS tag,
  CASE WHEN calmar IS NULL OR last_yr IS NULL THEN 'D' WHEN last_yr <= 0 OR calmar - 0.1 <= 0 THEN 'C' WHEN calmar - 0.1 >= 0.3 THEN CASE WHEN dd + 0.7 <= -0.2 THEN 'B' ELSE 'A' END ELSE 'B' END AS grade,
  CASE WHEN calmar IS NULL OR last_yr IS NULL THEN 'D' WHEN last_yr <= 0 OR calmar - 0.1 <= 0 THEN 'C' WHEN calmar - 0.1 >= 0.3 THEN 'A' ELSE 'B' END AS grade_without_dd, seg AS segments,
  coalesce(abs(ic) >= 0.02, false) AND coalesce(calmar > 0.3, false) AND coalesce(last_yr > 0.03, false) AND coalesce(ic_win > 0.4, false) AND (cal300 IS NULL OR cal300 <= 0.5) AS stripped_channel,
  coalesce(abs(ic) >= 0.02 AND ic_win >= 0.4 AND calmar >= 0.3 AND last_yr > 0 AND bad_years <= 1, false) OR c AS either_horizon,
  {r(f"abs(calmar) * (0.25 + 0.75 * CASE WHEN ic_win IS NOT NULL THEN {_unit('ic_win')} END)")} AS score_old, {r(f"({_unit('ic_win')}) * (0.5 + 0.5 * ({_unit('cal300')}))")} AS score_new, {r('CASE WHEN ic > 0 THEN ic ELSE 0 END')} AS score_ic_n, {r(_unit('cal500'))} AS score_mono_n FROM f"""


def rule_quality(spark, sf_dir):
    out = control.rule_quality(supplier_metrics(spark, sf_dir), F.col("ic") > 0.15, F.col("calmar") >= 0.2)
    return out.select(
        *["n", "n_pred", "n_true", "n_both"], *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "lift", "kill", "false_kill")],
    )


_RULE = f"""{_METRICS}, c AS (SELECT count(*) AS n, count(CASE WHEN ic > 0.15 THEN 1 END) AS n_pred, count(CASE WHEN calmar >= 0.2 THEN 1 END) AS n_true, count(CASE WHEN ic > 0.15 AND calmar >= 0.2 THEN 1 END) AS n_both FROM metrics)
SELECT n, n_pred, n_true, n_both, {r('n_both / n_pred::DOUBLE')} AS precision, {r('n_both / n_true::DOUBLE')} AS recall, {r('(n_both / n_pred::DOUBLE) / (n_true / n::DOUBLE)')} AS lift, {r('1 - n_pred / n::DOUBLE')} AS kill, {r('(n_true - n_both) / n_true::DOUBLE')} AS false_kill FROM c"""


def rule_grid(spark, sf_dir):
    out = control.rule_grid(supplier_metrics(spark, sf_dir), ["ic", "ic_win"], [[0.1, 0.2, 0.3], [0.4, 0.5]], F.col("calmar") >= 0.2)
    return out.select("x", "y", "n_pred", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"))


_GRID = f"""{_METRICS}, g AS (SELECT x, y, coalesce(ic >= x, false) AND coalesce(ic_win >= y, false) AS p, coalesce(calmar >= 0.2, false) AS q FROM metrics, (VALUES (0.1::DOUBLE), (0.2), (0.3)) a(x), (VALUES (0.4::DOUBLE), (0.5)) b(y))
SELECT x, y, count(CASE WHEN p THEN 1 END) AS n_pred, {r('CASE WHEN count(CASE WHEN p THEN 1 END) > 0 THEN count(CASE WHEN p AND q THEN 1 END) / count(CASE WHEN p THEN 1 END)::DOUBLE END')} AS precision, {r('count(CASE WHEN p AND q THEN 1 END) / count(CASE WHEN q THEN 1 END)::DOUBLE')} AS recall FROM g GROUP BY x, y"""


def rule_search(spark, sf_dir):
    """Orders of parts: which price and quantity a line must reach, or either, to be discounted by 8 % and more: 60 x 50 rules over all lines."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    prices, counts = [1000.0 * k for k in range(1, 61)], [float(k) for k in range(1, 51)]
    grids = [control.rule_grid(rows, ["p", "q"], [prices, counts], F.col("d") >= 0.08, both).withColumn("kind", F.lit(k)) for k, both in (("and", True), ("or", False))]
    return grids[0].unionByName(grids[1]).select("kind", "x", "y", "n_pred", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"))


_SEARCH = f"""WITH h AS (SELECT least(floor(l_extendedprice / 1000), 60) AS i, least(floor(l_quantity), 50) AS j, count(*) AS n, count(CASE WHEN l_discount >= 0.08 THEN 1 END) AS k FROM lineitem GROUP BY ALL),
g AS (SELECT a.x AS x, b.y AS y, sum(CASE WHEN i >= x AND j >= y THEN n ELSE 0 END) AS na, sum(CASE WHEN i >= x AND j >= y THEN k ELSE 0 END) AS ka, sum(CASE WHEN i >= x OR j >= y THEN n ELSE 0 END) AS no, sum(CASE WHEN i >= x OR j >= y THEN k ELSE 0 END) AS ko, sum(k) AS k FROM h, range(1, 61) a(x), range(1, 51) b(y) GROUP BY ALL),
o AS (SELECT 'and' AS kind, x, y, na AS n, ka AS m, k FROM g UNION ALL SELECT 'or', x, y, no, ko, k FROM g)
SELECT kind, x * 1000.0::DOUBLE AS x, CAST(y AS DOUBLE) AS y, CAST(n AS BIGINT) AS n_pred, {r('CASE WHEN n > 0 THEN m / n::DOUBLE END')} AS precision, {r('m / k::DOUBLE')} AS recall FROM o"""


def quotas(spark, sf_dir):
    m = supplier_metrics(spark, sf_dir)
    first = control.quota(m, "industry", 2, "calmar", SYM).select(
        SYM, F.lit("family").alias("kind"), F.col("place").cast("long").alias("place"),
    )
    best = control.best_per_key(m, ["pool"], "ic", SYM).select(SYM, F.lit("best").alias("kind"), F.lit(1).cast("long").alias("place"))
    kept = control.with_reserved(m, 20, 6, F.col("pool") == 3, "calmar", SYM).select(
        SYM, F.lit("reserved").alias("kind"), F.col("place").cast("long").alias("place"),
    )
    return first.unionByName(best).unionByName(kept)


_QUOTAS = f"""{_METRICS}, o AS (SELECT *, row_number() OVER (ORDER BY calmar DESC NULLS LAST, sym) AS place, coalesce(pool = 3, false) AS special FROM metrics), a AS (SELECT *, row_number() OVER (PARTITION BY special ORDER BY place) AS among FROM o),
s AS (SELECT *, row_number() OVER (ORDER BY (special AND among <= 6) DESC, place) AS slot FROM a)
SELECT sym, 'family' AS kind, CAST(p AS BIGINT) AS place FROM (SELECT sym, row_number() OVER (PARTITION BY industry ORDER BY calmar DESC NULLS LAST, sym) AS p FROM metrics) WHERE p <= 2
UNION ALL SELECT sym, 'best', 1 FROM (SELECT sym, row_number() OVER (PARTITION BY pool ORDER BY ic DESC NULLS LAST, sym) AS p FROM metrics) WHERE p = 1
UNION ALL SELECT sym, 'reserved', row_number() OVER (ORDER BY place) FROM s WHERE slot <= 20"""


def streams(spark, sf_dir):
    return _returns(spark, sf_dir).where("ret is not null and industry is not null").groupBy(
        F.col("industry").cast("long").alias("id"), T,
    ).agg(F.avg("ret").alias("x"))


def stream_correlation(spark, sf_dir):
    out = cb.stream_correlations(streams(spark, sf_dir))
    return out.select("a", "b", "n", rounded(F.col("corr")).alias("corr"))


_w = "OVER (PARTITION BY a, b ORDER BY {c})"
_STREAMS = f"""WITH {P2}, {LEAVES}, s AS (SELECT CAST(industry AS BIGINT) AS id, t, avg(ret) AS x FROM leaves WHERE ret IS NOT NULL AND industry IS NOT NULL GROUP BY ALL),
p AS (SELECT l.id AS a, q.id AS b, l.x AS xa, q.x AS xb FROM s l JOIN s q ON l.t = q.t AND l.id < q.id),
k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0 AS rb FROM p),
c AS (SELECT a, b, count(*) AS n, CASE WHEN count(*) >= 30 AND sqrt(var_pop(ra) * var_pop(rb)) > 1e-12 THEN covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) END AS corr FROM k GROUP BY a, b)"""


def largest(spark, sf_dir):
    out = cb.largest_correlation(cb.stream_correlations(streams(spark, sf_dir)))
    return out.select("id", rounded(F.col("max_corr")).alias("max_corr"), "with_id")


_LARGEST = f"""{_STREAMS}, b2 AS (SELECT a AS id, b AS other, corr FROM c UNION ALL SELECT b, a, corr FROM c)
SELECT id, {r('max(abs(corr))')} AS max_corr, arg_max(other, (abs(corr), -other)) AS with_id FROM b2 WHERE corr IS NOT NULL GROUP BY id"""


def similarity(spark, sf_dir):
    rows = base_rows(spark, sf_dir, extra={"g": "neg(ts_mean10(ret))", "h": "ts_mean10(intraday)"})
    out = cb.factor_similarity(rows, ["f", "g", "h"])
    return out.select("a", "b", rounded(F.col("similarity")).alias("similarity"), "days")


def _similarity_sql() -> str:
    from .along import _enough

    extra = f", -({_enough(f'avg(ret) {over(10)}', 10, 'ret')}) AS g, {_enough(f'avg(intraday) {over(10)}', 10, 'intraday')} AS h"
    parts = []
    for a, b in (("f", "g"), ("f", "h"), ("g", "h")):
        x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        parts.append(
            f"SELECT '{a}' AS a, '{b}' AS b, t, CASE WHEN count({x}) >= 20 AND sqrt(var_pop({x}) * var_pop({y})) > 1e-12 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END AS c FROM k GROUP BY t"
        )
    return f"""{base_sql(extra=extra)}, k AS (SELECT t, {ordinal('f')} AS f, {ordinal('g')} AS g, {ordinal('h')} AS h FROM base WHERE t % 5 = 0), d AS ({' UNION ALL '.join(parts)})
SELECT a, b, {r('quantile_cont(abs(c), 0.5)')} AS similarity, count(c) AS days FROM d GROUP BY a, b"""


def _ranks(spark, sf_dir):
    rows = base_rows(spark, sf_dir, extra={"g": "neg(ts_mean10(ret))"})
    return rows.select(SYM, T, cs.cs_rank(F.col("f")).alias("f"), cs.cs_rank(F.col("g")).alias("g"), "r")


def combine(spark, sf_dir):
    rows = _ranks(spark, sf_dir)
    ics = ev.daily_ic(rows, 20).select(T, F.col("ic").alias("f")).join(
        ev.daily_ic(rows.withColumn("f", F.col("g")), 20).select(T, F.col("ic").alias("g")), T,
    )
    equal = cb.combine_equal(rows, ["f", "g"]).withColumnRenamed("combo", "equal")
    return cb.combine_by_ic(equal, ics, ["f", "g"], 20, 1).withColumnRenamed("combo", "by_ic").select(
        SYM, F.col(T).cast("long").alias(T), rounded(F.col("equal")).alias("equal"), rounded(F.col("by_ic")).alias("by_ic"),
    )


def _combine_sql() -> str:
    from .across import avg_rank
    from .along import _enough
    from .scoring import _corr

    extra = f", -({_enough(f'avg(ret) {over(10)}', 10, 'ret')}) AS g"
    ic = lambda f: f"SELECT t, {_corr('x', 'y')} AS ic FROM (SELECT t, {avg_rank(f)} AS x, {avg_rank('r')} AS y FROM k WHERE {f} IS NOT NULL AND r IS NOT NULL) GROUP BY t HAVING count(*) >= 20"
    past = "OVER (ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    some = lambda wf, wg: f"(CASE WHEN f IS NOT NULL THEN f * {wf} ELSE 0 END + CASE WHEN g IS NOT NULL THEN g * {wg} ELSE 0 END)"
    tot = lambda wf, wg: f"(CASE WHEN f IS NOT NULL THEN {wf} ELSE 0 END + CASE WHEN g IS NOT NULL THEN {wg} ELSE 0 END)"
    div = lambda wf, wg: f"CASE WHEN {tot(wf, wg)} > 1e-12 THEN {some(wf, wg)} / {tot(wf, wg)} END"
    return f"""{base_sql(extra=extra)}, k AS (SELECT sym, t, {pct('f')} AS f, {pct('g')} AS g, r FROM base), icf AS ({ic('f')}), icg AS ({ic('g')}),
w AS (SELECT icf.t, CASE WHEN avg(icf.ic) {past.replace('t ROWS', 'icf.t ROWS')} > 0 THEN avg(icf.ic) {past.replace('t ROWS', 'icf.t ROWS')} ELSE 0 END AS wf, CASE WHEN avg(icg.ic) {past.replace('t ROWS', 'icf.t ROWS')} > 0 THEN avg(icg.ic) {past.replace('t ROWS', 'icf.t ROWS')} ELSE 0 END AS wg FROM icf JOIN icg ON icf.t = icg.t)
SELECT sym, CAST(k.t AS BIGINT) AS t, {r(div('1.0::DOUBLE', '1.0::DOUBLE'))} AS equal, {r(div('CASE WHEN coalesce(wf, 0) + coalesce(wg, 0) > 0 THEN wf ELSE 1 END', 'CASE WHEN coalesce(wf, 0) + coalesce(wg, 0) > 0 THEN wg ELSE 1 END'))} AS by_ic FROM k LEFT JOIN w ON w.t = k.t"""


def constrained(spark, sf_dir):
    out = cb.constrained(ev.on_grid(base_rows(spark, sf_dir)), 20, "pool", "mktcap", "f")
    return out.select(
        SYM, F.col(T).cast("long").alias(T), F.col("pool").cast("long").alias("pool"), F.col("quota").cast("long").alias("quota"),
        F.col("place").cast("long").alias("place"),
    )


_CONSTRAINED = f"""{base_sql()}, p AS (SELECT *, round(sum(mktcap) OVER (PARTITION BY t, pool) / sum(mktcap) OVER (PARTITION BY t) * 20) AS quota FROM base WHERE t % 5 = 0 AND f IS NOT NULL AND mktcap IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY t, pool ORDER BY f DESC, sym) AS place FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f DESC, sym) AS overall FROM k WHERE place <= quota)
SELECT sym, CAST(t AS BIGINT) AS t, CAST(pool AS BIGINT) AS pool, CAST(quota AS BIGINT) AS quota, place FROM o WHERE overall <= 20"""


# Point in time.


def as_of(spark, sf_dir):
    e = panels.read(spark, sf_dir, "events")
    kinds = [row[0] for row in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = e.where(F.col("event_type") == kinds[0]).select("event_id", "user_id", "ts", "value")
    right = e.where(F.col("event_type") == kinds[1]).groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    out = cb.as_of(left, right, "user_id", "ts", ["last_value"]).join(
        cb.as_of(
            left.select("event_id", "user_id", "ts"), right, "user_id", "ts", ["last_value"], strict=True,
        ).select("event_id", F.col("last_value").alias("before_value")),
        "event_id",
    )
    return out.select("event_id", "user_id", "value", "last_value", "before_value")


_AS_OF = """WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), l AS (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM k)),
q AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = (SELECT max(event_type) FROM k) GROUP BY ALL)
SELECT l.event_id, l.user_id, l.value, a.last_value, b.last_value AS before_value FROM l ASOF LEFT JOIN q a ON l.user_id = a.user_id AND l.ts >= a.ts ASOF LEFT JOIN q b ON l.user_id = b.user_id AND l.ts > b.ts"""


def pool_members(spark, sf_dir):
    s = panels.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SYM), (F.col("s_nationkey") % 2).cast("long").alias("pool"))
    changes = s.withColumn(
        "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))),
    ).where((F.col(SYM) + F.col("k")) % 3 != 0).select("pool", (F.col("k") * 24 + 5).alias("changed"), SYM)
    dates = panels.lineitem_panel(spark, sf_dir).select(F.col(T).cast("long").alias(T)).distinct()
    return cb.members_at(dates, changes).select("pool", T, SYM)


_POOL = f"""WITH {P2}, d AS (SELECT DISTINCT CAST(t AS BIGINT) AS t FROM panel), s AS (SELECT s_suppkey AS sym, CAST(s_nationkey % 2 AS BIGINT) AS pool FROM supplier), c AS (SELECT pool, k * 24 + 5 AS changed, sym FROM s, range(3) r(k) WHERE (sym + k) % 3 <> 0),
l AS (SELECT pool, changed, lead(changed) OVER (PARTITION BY pool ORDER BY changed) AS until FROM (SELECT DISTINCT pool, changed FROM c))
SELECT c.pool, CAST(t AS BIGINT) AS t, c.sym FROM l JOIN c ON c.pool = l.pool AND c.changed = l.changed, d WHERE t >= l.changed AND (until IS NULL OR t < until)"""


def price_adjust(spark, sf_dir):
    panel = panels.lineitem_panel(spark, sf_dir)
    factors = panel.where((F.col(T) % 20 == 3) & (F.col(SYM) % 2 == 0)).select(
        SYM, F.col(T).alias("start"), (1 + F.col(T) / 100).alias("factor"),
    )
    out = cb.adjust_prices(panel.select(SYM, T, "close", "volume"), factors, ["close"], "volume", least=50)
    return out.select(
        SYM, F.col(T).cast("long").alias(T), rounded(F.col("close"), 4).alias("close"), rounded(F.col("volume"), 4).alias("volume"),
    )


_ADJUST = f"""WITH {P2}, f AS (SELECT sym, t, CASE WHEN t % 20 = 3 AND sym % 2 = 0 THEN 1 + t / 100.0::DOUBLE END AS f, close, volume FROM panel),
g AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY sym ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM f), h AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM g)
SELECT sym, CAST(t AS BIGINT) AS t, {r('close * coalesce(c / z, 1)', 4)} AS close, {r('volume / coalesce(c / z, 1)', 4)} AS volume FROM h WHERE sym IN (SELECT sym FROM panel GROUP BY sym HAVING count(close) >= 50)"""


def _flag_lists(spark, sf_dir):
    """Per symbol the dates of two flags, as lists: special treatment and suspension."""
    ids = panels.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SYM))
    days = lambda start, step: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: ((F.col(SYM) + start + k * step) % 97).cast("int"))
    return ids.where(f"{SYM} % 3 = 0").select(SYM, days(5, 11).alias("st"), days(40, 7).alias("suspended"))


def universe(spark, sf_dir):
    panel = panels.lineitem_panel(spark, sf_dir)
    pc, first = F.lag("close").over(Window.partitionBy(SYM).orderBy(T)), F.min(
        F.when(F.col("close").isNotNull(), F.col(T))
    ).over(Window.partitionBy(SYM))
    panel = panel.withColumns(
        {"limit_up": pc * 1.6, "limit_down": pc * 0.4, "listed": first, "delisted": F.when(F.col(SYM) % 7 == 0, F.lit(60))}
    )
    panel = cb.with_flags(panel, _flag_lists(spark, sf_dir), ["st", "suspended"])
    return panel.select(SYM, F.col(T).cast("long").alias(T), "st", "suspended", cb.universe(panel, 24, 20, 10, 300_000.0).alias("inside"))


_UNIVERSE = f"""WITH {P2}, q AS (SELECT s_suppkey AS sym FROM supplier WHERE s_suppkey % 3 = 0), st AS (SELECT DISTINCT sym, (sym + 5 + k * 11) % 97 AS t FROM q, range(7) a(k)), su AS (SELECT DISTINCT sym, (sym + 40 + k * 7) % 97 AS t FROM q, range(7) a(k)),
k AS (SELECT p.*, lag(close) {_LINE} AS pc, min(CASE WHEN close IS NOT NULL THEN t END) OVER (PARTITION BY sym) AS listed, count(turnover) {over(20)} AS n, avg(turnover) {over(20)} AS m FROM panel p)
SELECT k.sym, CAST(k.t AS BIGINT) AS t, st.sym IS NOT NULL AS st, su.sym IS NOT NULL AS suspended,
  CASE WHEN k.t - (k.listed + 1) >= 24 AND close IS NOT NULL AND (k.sym % 7 <> 0 OR k.t <= 60) AND st.sym IS NULL AND su.sym IS NULL AND n >= 10 AND m >= 300000 AND close < pc * 1.6 - 1e-6 AND close > pc * 0.4 + 1e-6 THEN true ELSE false END AS inside
FROM k LEFT JOIN st ON st.sym = k.sym AND st.t = k.t LEFT JOIN su ON su.sym = k.sym AND su.t = k.t"""


_SHARES = ("top5", "top10", "top20", "top50")


def concentration(spark, sf_dir):
    out = cb.concentration(panels.lineitem_panel(spark, sf_dir), spans={"short": 24, "long": 60}, least=12)
    return out.select(
        F.col(T).cast("long").alias(T),
        *[rounded(F.col(c)).alias(c) for c in (*_SHARES, *[f"{c}_{k}" for c in _SHARES for k in ("short", "long")])],
    )


def _conc_sql() -> str:
    shares = ", ".join(
        f"sum(CASE WHEN k <= greatest(floor(n * {p}), 1) THEN turnover END) / sum(turnover) AS top{int(p * 100)}" for p in (0.05, 0.1, 0.2, 0.5)
    )
    within = lambda c, w: f"(SELECT CASE WHEN count(*) >= 12 THEN (count(*) FILTER (WHERE b.{c} < a.{c}) + (count(*) FILTER (WHERE b.{c} = a.{c}) + 1) / 2.0) / count(*) END FROM s b WHERE b.t BETWEEN a.t - {w - 1} AND a.t)"
    ranks = ", ".join(f"{r(within(c, w))} AS {c}_{k}" for c in _SHARES for k, w in (("short", 24), ("long", 60)))
    return f"""WITH {P2}, k AS (SELECT t, turnover, row_number() OVER (PARTITION BY t ORDER BY turnover DESC, sym) AS k, count(*) OVER (PARTITION BY t) AS n FROM panel WHERE turnover IS NOT NULL), s AS (SELECT t, {shares} FROM k GROUP BY t)
SELECT CAST(t AS BIGINT) AS t, {', '.join(f'{r(c)} AS {c}' for c in _SHARES)}, {ranks} FROM s a"""


# Aggregates, windows and scalars on the raw tables.


def group_statistics(spark, sf_dir):
    o = panels.read(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), rounded(F.avg("o_totalprice"), 2).alias("mean"), rounded(
            F.percentile("o_totalprice", F.lit(0.1)), 2,
        ).alias("p10"),
        rounded(
            F.percentile("o_totalprice", F.lit(0.5)), 2,
        ).alias("p50"), rounded(F.percentile("o_totalprice", F.lit(0.9)), 2).alias("p90"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
    )


_GROUPS = f"""SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, {r('avg(o_totalprice)', 2)} AS mean, {r('quantile_cont(o_totalprice, 0.1)', 2)} AS p10, {r('quantile_cont(o_totalprice, 0.5)', 2)} AS p50, {r('quantile_cont(o_totalprice, 0.9)', 2)} AS p90, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1"""


def diversity(spark, sf_dir):
    """Counts, shares, Herfindahl index and share of the three largest."""
    counts = panels.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    ranked = counts.withColumns({"total": F.sum("n").over(whole), "place": F.row_number().over(Window.orderBy(F.desc("n"), "value"))})
    ranked = ranked.withColumn("hhi", F.sum(F.pow(F.col("n") / F.col("total"), 2)).over(whole)).withColumn(
        "top3", F.sum(F.when(F.col("place") <= 3, F.col("n") / F.col("total"))).over(whole),
    )
    return ranked.select(
        "value", "n", F.col("place").cast("long").alias("place"), rounded(F.col("hhi")).alias("hhi"), rounded(F.col("top3")).alias("top3"),
    )


_DIVERSITY = f"""WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, value) AS place FROM c)
SELECT value, n, place, {r('sum((n / total::DOUBLE) * (n / total::DOUBLE)) OVER ()')} AS hhi, {r('sum(CASE WHEN place <= 3 THEN n / total::DOUBLE END) OVER ()')} AS top3 FROM k"""


def pivoted(spark, sf_dir):
    """Last price per month and status, wide."""
    o = panels.read(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").cast("int").alias("month"), "o_orderstatus", "o_totalprice", "o_orderkey",
    )
    return o.groupBy("month").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max_by("o_totalprice", "o_orderkey"))


_PIVOT = "SELECT CAST(strftime(o_orderdate, '%Y%m') AS INT) AS month, " + ", ".join(
    f"arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP"
) + " FROM orders GROUP BY 1"


def weighted_means(spark, sf_dir):
    p = _returns(spark, sf_dir).where("ret is not null and mktcap is not null")
    return p.groupBy(T).agg(
        rounded(F.try_divide(F.sum(F.col("ret") * F.col("mktcap")), F.sum("mktcap"))).alias("weighted"),
        rounded(F.avg("ret")).alias("equal"), rounded(F.exp(F.sum(F.log1p(F.col("ret") * 0.01))) - 1).alias("compounded"),
    ).withColumn(T, F.col(T).cast("long"))


_WEIGHTED = f"""WITH {P2}, {LEAVES} SELECT CAST(t AS BIGINT) AS t, {r('sum(ret * mktcap) / sum(mktcap)')} AS weighted, {r('avg(ret)')} AS equal, {r('exp(sum(ln(1 + ret * 0.01))) - 1')} AS compounded FROM leaves WHERE ret IS NOT NULL AND mktcap IS NOT NULL GROUP BY t"""


def first_triggers(spark, sf_dir):
    """The first event of each run of a user's events with no gap above a day, and the autocorrelation of the user's values."""
    e = panels.read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumns({"gap": F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)), "prev": F.lag("value").over(w)})
    den = F.sqrt(F.var_pop(F.when(F.col("prev").isNotNull(), F.col("value"))) * F.var_pop("prev"))
    ar = F.when(den > 1e-12, F.try_divide(F.covar_pop("value", "prev"), den))
    return e.groupBy("user_id").agg(
        F.count(F.when(F.col("gap").isNull() | (F.col("gap") > 86_400_000_000), 1)).alias("runs"), F.count("*").alias("n"),
        rounded(ar).alias("ar1"),
    )


_TRIGGERS = f"""WITH k AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, lag(value) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 END) AS runs, count(*) AS n,
{r('CASE WHEN sqrt(var_pop(CASE WHEN prev IS NOT NULL THEN value END) * var_pop(prev)) > 1e-12 THEN covar_pop(value, prev) / sqrt(var_pop(CASE WHEN prev IS NOT NULL THEN value END) * var_pop(prev)) END')} AS ar1 FROM k GROUP BY user_id"""


def trigger_rows(spark, sf_dir):
    """The first event of each run itself."""
    e = panels.read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rp.first_of_runs(e, ["user_id"], ["at", "event_id"], 86_400_000_000).select("user_id", "event_id")


_TRIGGER_ROWS = """SELECT user_id, event_id FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap IS NULL OR gap > 86400000000"""


def codes_and_dates(spark, sf_dir):
    c = panels.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 733).cast("string").alias("raw"))
    o = F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"))
    day = F.when(
        F.col("c_custkey") % 4 == 0, F.concat(o, F.lit("-2-"), (F.col("c_custkey") % 9 + 1).cast("string")),
    ).when(F.col("c_custkey") % 4 == 1, F.concat(o, F.lit("0315"))).when(F.col("c_custkey") % 4 == 2, F.lit("0000-00-00")).otherwise(F.lit("n/a"))
    return c.select(
        "c_custkey", scalar.exchange_code(F.concat(F.lit("c"), F.col("raw"))).alias("code"), scalar.from_short_suffix(
            F.concat(F.lpad("raw", 6, "0"), F.lit(".sz"))
        ).alias("long_code"), scalar.date_key(day).alias("day"),
        scalar.quarter_key(F.concat(o, F.lit("q"), (F.col("c_custkey") % 4 + 1).cast("string"))).alias("quarter"), scalar.skeleton_text(
            F.concat(
                F.lit("ts_mean"), F.col("raw"),
                F.when(F.col("c_custkey") % 2 == 0, F.lit("(close)")).otherwise(
                    F.concat(F.lit("(close, ema"), F.col("c_custkey").cast("string"), F.lit("(ret))"))
                ),
            )
        ).alias("shape"),
        F.md5("raw").alias("md5"), scalar.date_key_or(day, 19000101).alias("listed"), scalar.json_object(F.concat(F.lit('so {"k": '), F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("raw")), F.lit("} it is"))).alias("object"), F.array_join(
            scalar.identifiers(F.concat(F.lit("sub(ts_mean"), F.col("raw"), F.lit("(close), open_"), F.substring("raw", 1, 1), F.lit(")"))),
            " ",
        ).alias("tokens"),
    )


_o = "'20' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0')"
_CODES = f"""WITH c AS (SELECT c_custkey, CAST(c_custkey * 733 AS VARCHAR) AS raw, {_o} AS o FROM customer), d AS (SELECT *, CASE WHEN length(raw) > 6 THEN left(raw, 6) ELSE lpad(raw, 6, '0') END AS six FROM c)
SELECT c_custkey, CASE WHEN left(six, 1) IN ('6', '9') THEN six || '.XSHG' WHEN left(six, 1) IN ('0', '2', '3') THEN six || '.XSHE' WHEN left(six, 1) IN ('4', '8') THEN six || '.XBSE' END AS code, six || '.XSHE' AS long_code,
CAST(CASE WHEN c_custkey % 4 = 0 THEN o || '02' || lpad(CAST(c_custkey % 9 + 1 AS VARCHAR), 2, '0') WHEN c_custkey % 4 = 1 THEN o || '0315' END AS INT) AS day, coalesce(CAST(CASE WHEN c_custkey % 4 = 0 THEN o || '02' || lpad(CAST(c_custkey % 9 + 1 AS VARCHAR), 2, '0') WHEN c_custkey % 4 = 1 THEN o || '0315' END AS INT), 19000101) AS listed, CASE WHEN c_custkey % 5 <> 0 THEN '{{"k": ' || raw || '}}' END AS object, CAST(CAST(o AS INT) * 4 + c_custkey % 4 AS INT) AS quarter, 'ts_mean(close' || CASE WHEN c_custkey % 2 = 0 THEN ')' ELSE ', ema(ret))' END AS shape, md5(raw) AS md5, 'sub ts_mean' || raw || ' close open_' || left(raw, 1) AS tokens FROM d"""


def sampled(spark, sf_dir):
    """A seeded sample without replacement by hash order, and each customer nation's order curve thinned to ten points with its ends."""
    s = panels.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.md5(F.concat_ws(":", F.lit(42), "s_suppkey")).alias("h"),
    ).orderBy("h").limit(20).select("id", F.lit("sample").alias("kind"), F.lit(0.0).alias("y"))
    o = panels.read(spark, sf_dir, "orders").groupBy(
        F.date_format("o_orderdate", "yyyyMM").cast("long").alias("id")
    ).agg(F.sum("o_totalprice").alias("y")).withColumn("kind", F.lit("curve"))
    return s.unionByName(rp.thinned(o, ["kind"], "id", 10).select("id", "kind", rounded(F.col("y"), 2).alias("y")))


_SAMPLED = f"""WITH o AS (SELECT CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS id, sum(o_totalprice) AS y FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM o)
SELECT id, 'sample' AS kind, 0.0::DOUBLE AS y FROM (SELECT s_suppkey AS id FROM supplier ORDER BY md5('42:' || s_suppkey) LIMIT 20) UNION ALL SELECT id, 'curve', {r('y', 2)} FROM k WHERE i IN (SELECT CAST(floor(j * (n - 1) / 9.0) AS BIGINT) FROM range(10) t(j))"""


def wide_batch(spark, sf_dir):
    """Many expressions in one plan, with shared subtrees and changes of axis."""
    texts = {
        "e1": "cs_rank(sub(ts_mean5(close), ts_mean20(close)))", "e2": "mul(cs_rank(ts_std20(ret)), sign(ts_delta5(ln_volume)))", "e3": "ts_mean5(cs_demean(intraday))", "e4": "cs_scale(ts_mean5(cs_demean(intraday)))",
        "e5": "div(ts_max20(high), ts_min20(low))",
    }
    made = evaluate(_returns(spark, sf_dir), {k: parse(v) for k, v in texts.items()})
    return made.select(SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(k), 5).alias(k) for k in texts])


def _wide_sql() -> str:
    from .along import _enough

    a = {w: _enough(f"avg(close) {over(w)}", w, "close") for w in (5, 20)}
    return f"""WITH {P2}, {LEAVES}, a AS (SELECT sym, t, {a[5]} - {a[20]} AS d, {_enough(f'stddev_pop(ret) {over(20)}', 20, 'ret')} AS s, ln_volume - lag(ln_volume, 5) {_LINE} AS v, intraday - avg(intraday) OVER (PARTITION BY t) AS i,
  {_enough(f'max(high) {over(20)}', 20, 'high')} AS hi, {_enough(f'min(low) {over(20)}', 20, 'low')} AS lo FROM leaves), b AS (SELECT *, {_enough(f'avg(i) {over(5)}', 5, 'i')} AS m FROM a)
SELECT sym, CAST(t AS BIGINT) AS t, {r(pct('d'), 5)} AS e1, {r(f"({pct('s')}) * sign(v)", 5)} AS e2, {r('m', 5)} AS e3, {r(f"({pct('m')} - 0.5) * 2", 5)} AS e4, {r('CASE WHEN abs(lo) > 1e-9 THEN hi / lo END', 5)} AS e5 FROM b"""


QUERIES = {
    "gates": (gates, _GATES),
    "rule_quality": (rule_quality, _RULE),
    "rule_grid": (rule_grid, _GRID),
    "rule_search": (rule_search, _SEARCH),
    "quotas": (quotas, _QUOTAS),
    "stream_correlation": (stream_correlation, f"{_STREAMS} SELECT a, b, n, {r('corr')} AS corr FROM c"),
    "largest_correlation": (largest, _LARGEST),
    "factor_similarity": (similarity, _similarity_sql()),
    "combine": (combine, _combine_sql()),
    "constrained_portfolio": (constrained, _CONSTRAINED),
    "as_of_join": (as_of, _AS_OF),
    "pool_members": (pool_members, _POOL),
    "price_adjust": (price_adjust, _ADJUST),
    "universe": (universe, _UNIVERSE),
    "concentration": (concentration, _conc_sql()),
    "group_statistics": (group_statistics, _GROUPS),
    "diversity": (diversity, _DIVERSITY),
    "pivot_last": (pivoted, _PIVOT),
    "weighted_means": (weighted_means, _WEIGHTED),
    "first_triggers": (first_triggers, _TRIGGERS),
    "trigger_rows": (trigger_rows, _TRIGGER_ROWS),
    "codes_and_dates": (codes_and_dates, _CODES),
    "sampling": (sampled, _SAMPLED),
    "expression_batch": (wide_batch, _wide_sql()),
}

"""Reports of one factor and of a library, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cs
from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..operators import backtest as bt
from ..operators import combination as cb
from ..operators import evaluation as ev
from ..operators import reports as rp
from ..sources import panels, store
from ..sources.shared import ensure_checkpoint_dir
from .across import base_rows, base_sql, left_over, ordinal
from .along import _enough
from .base import line, r
from .general import _METRICS, supplier_metrics
from .reporting import _stripped_rows
from .scoring import _DECILES, _LIMIT, _MARKS_CTES, _RECORD, _corr, _metrics_sql, _per_sql, _record_sql, _shown, _stream_sql, _traded

_LEAST = {"least": 30, "least_top": 2, "least_pool": 20}
_w = "OVER (PARTITION BY t)"


def neutralised_returns(spark, sf_dir):
    """Returns without two styles; rows that lack a style, and thin dates, keep their own."""
    rows = base_rows(spark, sf_dir).withColumn("z", F.when((F.col(T) % 9 != 0) | (F.col(SYM) < 20), F.col("ln_volume")))
    out = ev.neutralize_rows(rows, "r", ["ln_mktcap", "z"], "left", 30)
    return out.select(SYM, F.col(T).cast("long").alias(T), rounded(F.col("left"), 5).alias("left"))


_NEUTRAL_RETURNS = f"""{base_sql()}, a AS (SELECT sym, t, r, ln_mktcap AS x1, CASE WHEN t % 9 <> 0 OR sym < 20 THEN ln_volume END AS x2 FROM base), b AS (SELECT * FROM a WHERE r IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (SELECT *, count(*) {_w} AS n, var_pop(x1) {_w} AS s11, var_pop(x2) {_w} AS s22, covar_pop(x1, x2) {_w} AS s12, covar_pop(r, x1) {_w} AS s1, covar_pop(r, x2) {_w} AS s2, avg(r) {_w} AS my, avg(x1) {_w} AS m1, avg(x2) {_w} AS m2 FROM b),
e AS (SELECT sym, t, r - (my + (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2)) AS e FROM m WHERE n >= 30)
SELECT a.sym, CAST(a.t AS BIGINT) AS t, {r('coalesce(e, r)', 5)} AS "left" FROM a LEFT JOIN e ON e.sym = a.sym AND e.t = a.t"""


def neutral_ic(spark, sf_dir):
    rows = base_rows(spark, sf_dir, extra={"g": "neg(ts_mean10(ret))"})
    out = ev.neutral_ic(rows, ["f", "g"], ["ln_mktcap", "ln_volume"], least=20)
    return out.select("factor", F.col("days").cast("long").alias("days"), rounded(F.col("ic_n"), 5).alias("ic_n"))


def _neutral_ic_sql() -> str:
    extra = f", -({_enough(f'avg(ret) {line(10)}', 10, 'ret')}) AS g"
    parts = " UNION ALL ".join(f"SELECT '{c}' AS factor, t, {ordinal(c)} AS x, {ordinal('y')} AS y FROM z" for c in "fg")
    return f"""{base_sql(extra=extra)}, a AS (SELECT sym, t, f, g, r, ln_mktcap AS x1, ln_volume AS x2 FROM base WHERE t % 5 = 0), b AS (SELECT * FROM a WHERE r IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (SELECT *, count(*) {_w} AS n, var_pop(x1) {_w} AS s11, var_pop(x2) {_w} AS s22, covar_pop(x1, x2) {_w} AS s12, covar_pop(r, x1) {_w} AS s1, covar_pop(r, x2) {_w} AS s2, avg(r) {_w} AS my, avg(x1) {_w} AS m1, avg(x2) {_w} AS m2 FROM b),
e AS (SELECT sym, t, r - (my + (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2)) AS e FROM m WHERE n >= 20),
z AS (SELECT a.sym, a.t, f, g, coalesce(e, r) AS y FROM a LEFT JOIN e ON e.sym = a.sym AND e.t = a.t), k AS ({parts}), d AS (SELECT factor, t, {_corr('x', 'y')} AS c FROM k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY factor, t HAVING count(*) >= 20)
SELECT factor, count(c) AS days, {r('abs(avg(c))', 5)} AS ic_n FROM d GROUP BY factor"""


_STRIPS = {"none": [], "size": ["ln_mktcap"], "volume": ["ln_volume"], "both": ["ln_mktcap", "ln_volume"]}
_STRIPPED = ("ann_ex", "dd", "calmar", "sharpe", "turn", "ann_ex_cw", "dd_cw", "calmar_cw")


def attribution(spark, sf_dir):
    """The backtest of the factor as it is and with size, volume and both stripped from its ranks, against the even and the weighted market: all
    residuals come from one pass of sums."""
    ensure_checkpoint_dir(spark)
    rows = base_rows(spark, sf_dir)
    ranked = rows.withColumns({"__f": cs.ordinal_rank(F.col("f"))} | {f"__{c}": cs.ordinal_rank(F.col(c)) for c in _STRIPS["both"]})
    left = ev.nested_residuals(ranked, "__f", {k: [f"__{c}" for c in v] for k, v in _STRIPS.items()}, 30).checkpoint()
    out = None
    for name in _STRIPS:
        made = bt.record(bt.trades(left.withColumn("f", cs.ordinal_rank(F.col(name))), limit=_LIMIT), daily=False, least_periods=3, **_LEAST)
        made = made.select(F.lit(name).alias("strip"), "periods", *[rounded(F.col(c)).alias(c) for c in _STRIPPED])
        out = made if out is None else out.unionByName(made)
    return out


def _attribution_sql() -> str:
    parts = []
    for name, held in _STRIPS.items():
        given = "".join(f" AND {c} IS NOT NULL" for c in held)
        left = f"""k0 AS (SELECT sym, t, {ordinal('f')} AS y, {', '.join(f'{ordinal(c)} AS {c}' for c in _STRIPS['both'])} FROM raw),
zv AS (SELECT sym, t, {left_over(held)} AS v, count(*) OVER (PARTITION BY t) AS m FROM k0 WHERE y IS NOT NULL{given}), zo AS (SELECT sym, t, {ordinal('v')} AS f FROM zv WHERE m >= 30),
base AS (SELECT raw.* REPLACE (zo.f AS f) FROM raw LEFT JOIN zo ON zo.sym = raw.sym AND zo.t = raw.t)"""
        per = _per_sql().replace(", base AS (", ", raw AS (", 1).replace("  FROM leaves\n)", f"  FROM leaves\n), {left}", 1)
        streams_ = ", ".join(_stream_sql(k, "per", c, "t", "n * 5 / 243.0", "243 / 5.0") for k, c in (("xs", "excess"), ("xw", "excess_w")))
        cols = {"ann_ex": "xs.ann", "dd": "xs.dd", "calmar": "xs.calmar", "sharpe": "xs.sharpe", "turn": "(SELECT avg(turn) FROM per)", "ann_ex_cw": "xw.ann", "dd_cw": "xw.dd", "calmar_cw": "xw.calmar"}
        parts.append(f"SELECT * FROM ({per}, {streams_} SELECT '{name}' AS strip, xs.n AS periods, {', '.join(f'{r(v)} AS {k}' for k, v in cols.items())} FROM xs, xw)")
    return " UNION ALL ".join(parts)


def pool_record(spark, sf_dir):
    """The record of the factor inside three pools: others are masked, members ranked among themselves, weighted market included."""
    rows = rp.restricted(base_rows(spark, sf_dir), F.col("pool").isin(1, 2, 3))
    out = bt.record(bt.trades(rows, limit=_LIMIT), least_periods=10, **_LEAST)
    return _shown(out, _RECORD, ("periods", "bad_years"))


_POOL_RECORD = _record_sql(_per_sql(f="CASE WHEN pool IN (1, 2, 3) THEN f END") + _MARKS_CTES)


def strip_record(spark, sf_dir):
    """The record of what two styles leave of the factor, beside its own excess."""
    base = base_rows(spark, sf_dir)
    rows = ev.neutralised(base, "f", "ln_mktcap", "ln_volume", "neutral", least=30).withColumn("f", F.col("neutral"))
    out = bt.record(bt.trades(rows, limit=_LIMIT), least_periods=10, **_LEAST)
    return _shown(out, _RECORD, ("periods", "bad_years"))


_STRIP_RECORD = _record_sql(_per_sql(**_stripped_rows()) + _MARKS_CTES)


def extra_strip(spark, sf_dir):
    """The same with two other styles, such as value outstanding and the share of it that is restricted."""
    rows = ev.neutralised(base_rows(spark, sf_dir), "f", "ln_volume", "turn_ratio", "neutral", least=30).withColumn("f", F.col("neutral"))
    per = bt.periods(bt.trades(rows, limit=_LIMIT), **_LEAST)
    return _shown(bt.metrics(per), ("ann_ex", "dd", "calmar", "sharpe", "turn"), ("periods",))


_EXTRA = _metrics_sql(_per_sql(**_stripped_rows("ln_volume", "turn_ratio")))


def metric_table(spark, sf_dir):
    """Both signs of the factor over two horizons: the sign of the mean IC is the one whose figures are kept."""
    parts = []
    for step in (3, 5):
        rows = base_rows(spark, sf_dir, step)
        ic = ev.daily_ic(rows, 20).agg(F.avg("ic").alias("ic"))
        signed = rows.crossJoin(ic).withColumns(
            {"sign": F.when(F.col("ic") < 0, -1).otherwise(1), "f": F.when(F.col("ic") < 0, -F.col("f")).otherwise(F.col("f"))}
        )
        m = bt.metrics(bt.periods(bt.trades(signed, step=step, limit=_LIMIT), step=step, **_LEAST), step=step)
        parts.append(
            m.crossJoin(ic).select(
                F.lit(step).cast("long").alias("horizon"), F.when(F.col("ic") < 0, -1).otherwise(1).cast("long").alias("sign"),
                rounded(F.abs("ic")).alias("ic"), F.col("periods").cast("long").alias("periods"),
                *[rounded(F.col(c)).alias(c) for c in ("ann_ex", "dd", "sharpe", "turn")],
            )
        )
    return parts[0].unionByName(parts[1])


def _metric_table_sql() -> str:
    from .across import avg_rank

    def part(step: int) -> str:
        ctes = f""", icp AS (SELECT t, {avg_rank('f')} AS x, {avg_rank('r')} AS y FROM base WHERE f IS NOT NULL AND r IS NOT NULL), icd AS (SELECT {_corr('x', 'y')} AS ic FROM icp GROUP BY t HAVING count(*) >= 20), icm AS (SELECT avg(ic) AS ic FROM icd),
signed AS (SELECT base.*, CASE WHEN (SELECT ic FROM icm) < 0 THEN -f ELSE f END AS g FROM base)"""
        inner = _metrics_sql(_per_sql(step=step, ctes=ctes, source="signed", f="g"), step=step)
        head, tail = inner.rsplit("\nSELECT ", 1)
        return f"{head}\nSELECT CAST({step} AS BIGINT) AS horizon, CASE WHEN (SELECT ic FROM icm) < 0 THEN CAST(-1 AS BIGINT) ELSE 1 END AS sign, {r('abs((SELECT ic FROM icm))')} AS ic, {tail}"

    cols = "horizon, sign, ic, periods, ann_ex, dd, sharpe, turn"
    return f"SELECT {cols} FROM ({part(3)}) UNION ALL SELECT {cols} FROM ({part(5)})"


def decile_curves(spark, sf_dir):
    """Net asset value of every decile, and the plain correlation of factor and return, per rebalancing date."""
    out = rp.decile_curves(base_rows(spark, sf_dir), least=30, least_in_bucket=2)
    return out.select(
        F.col(T).cast("long").alias(T), F.col("d").cast("long").alias("d"), rounded(F.col("nav")).alias("nav"),
        rounded(F.col("pearson")).alias("pearson"),
    )


_CURVES = f"""{_DECILES}, p AS (SELECT t, CASE WHEN count(*) >= 30 THEN corr(f, r) END AS pearson FROM base WHERE t % 5 = 0 AND f IS NOT NULL AND r IS NOT NULL GROUP BY t)
SELECT CAST(b.t AS BIGINT) AS t, CAST(d AS BIGINT) AS d, {r('exp(sum(ln(1 + ret)) OVER (PARTITION BY d ORDER BY b.t ROWS UNBOUNDED PRECEDING))')} AS nav, {r('pearson')} AS pearson FROM b LEFT JOIN p ON p.t = b.t"""


def style_years(spark, sf_dir):
    """The correlation with each style by years: t over the yearly means, and the share of years of the prevailing sign."""
    out = rp.style_years(base_rows(spark, sf_dir), ["ln_mktcap", "ln_volume", "turn_ratio"], least=20, least_days=6)
    return out.select(
        "style", F.col("years").cast("long").alias("years"), rounded(F.col("t_year")).alias("t_year"),
        rounded(F.col("win_year")).alias("win_year"),
    )


def _style_years_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS style, date, t, {ordinal('f')} AS x, {ordinal(c)} AS y FROM base" for c in ("ln_mktcap", "ln_volume", "turn_ratio")
    )
    return f"""{base_sql()}, k AS ({parts}), d AS (SELECT style, any_value(date) // 100 AS y, {_corr('x', 'y')} AS c FROM k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY style, t HAVING count(*) >= 20),
m AS (SELECT style, y, avg(c) AS c FROM d WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 6)
SELECT style, count(*) AS years, {r('CASE WHEN count(*) >= 4 AND stddev_pop(c) > 1e-12 THEN avg(c) / stddev_pop(c) * sqrt(count(*)) END')} AS t_year, {r('greatest(avg(CASE WHEN c > 0 THEN 1 ELSE 0 END), avg(CASE WHEN c < 0 THEN 1 ELSE 0 END))')} AS win_year FROM m GROUP BY style"""


def standard_report(spark, sf_dir):
    """One long table (section, item, value): figures by horizon, by year, by segment, by decile, and style exposures."""
    sections = []
    add = lambda df, section, item, value: sections.append(df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), rounded(F.col(value)).alias("value")))
    for step in (3, 5):
        m = bt.metrics(
            bt.periods(bt.trades(base_rows(spark, sf_dir, step), step=step, limit=_LIMIT), step=step, by_pct=True, actual=True, **_LEAST),
            step=step,
        )
        add(m.withColumn("k", F.lit(step)), "horizon", "k", "ann_ex")
    per = bt.periods(_traded(spark, sf_dir), by_pct=True, actual=True, **_LEAST)
    add(bt.yearly(per), "year", "year", "excess")
    add(bt.segments(per), "segment", "segment", "excess")
    rows = base_rows(spark, sf_dir)
    add(ev.decile_periods(rows, least=30, least_in_bucket=2).groupBy("d").agg(F.avg("ret").alias("ret")), "decile", "d", "ret")
    add(ev.style_exposure(rows, ["ln_mktcap", "ln_volume"], least=20), "style", "style", "expo")
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def _report_sql() -> str:
    per = lambda step: _per_sql(by_pct=True, actual=True, step=step)
    horizon = " UNION ALL ".join(
        f"SELECT 'horizon' AS section, '{k}' AS item, ann_ex AS value FROM ({_metrics_sql(per(k), step=k)})" for k in (3, 5)
    )
    style = " UNION ALL ".join(
        f"SELECT '{c}' AS style, t, {ordinal('f')} AS x, {ordinal(c)} AS y FROM base" for c in ("ln_mktcap", "ln_volume")
    )
    return f"""{horizon}
UNION ALL SELECT 'year', CAST(date // 100 AS VARCHAR), {r('product(1 + excess) - 1')} FROM ({per(5)} SELECT * FROM per) GROUP BY date // 100
UNION ALL SELECT 'segment', CAST(k AS VARCHAR), {r('product(1 + excess) - 1')} FROM (SELECT *, ntile(3) OVER (ORDER BY t) AS k FROM ({per(5)} SELECT * FROM per)) GROUP BY k
UNION ALL SELECT 'decile', CAST(CAST(d AS INT) AS VARCHAR), {r('avg(ret)')} FROM ({_DECILES} SELECT * FROM b) GROUP BY d
UNION ALL SELECT 'style', style, {r('avg(c)')} FROM ({base_sql()}, k AS ({style}) SELECT style, {_corr('x', 'y')} AS c FROM k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY style, t HAVING count(*) >= 20) GROUP BY style"""


_POOLS = {"all": "true", "west": "pool IN (1, 2)", "rest": "pool IN (0, 3, 4)"}


def combo_check(spark, sf_dir):
    """The factor in three pools, with tilt, segments and decay."""
    out = rp.combo_check(base_rows(spark, sf_dir), {k: F.expr(v) for k, v in _POOLS.items()}, _LIMIT, least_periods=10, **_LEAST)
    return out.select(
        "pool", *[rounded(F.col(c)).alias(c) for c in ("ann_ex", "ann_ex_cw", "tilt", "calmar", "turn")], "positive", "decays",
    )


def _combo_sql() -> str:
    def part(name: str, test: str) -> str:
        per = _per_sql(f=f"CASE WHEN {test} THEN f END")
        cuts = f"{per}, cut AS (SELECT excess, ntile(3) OVER (ORDER BY t) AS k FROM per) SELECT k, product(1 + excess) - 1 AS x FROM cut GROUP BY k"
        return f"SELECT '{name}' AS pool, ann_ex, ann_ex_cw, tilt, calmar, turn, (SELECT count(*) FROM ({cuts}) WHERE x > 0) AS positive, (SELECT max(x) FILTER (WHERE k = 3) < 0.6 * max(x) FILTER (WHERE k = 1) FROM ({cuts})) AS decays FROM ({_record_sql(per + _MARKS_CTES)})"

    return " UNION ALL ".join(part(k, v) for k, v in _POOLS.items())


_FACTORS = {"g": "neg(ts_mean10(ret))", "h": "ts_mean10(intraday)", "k": "ts_mean20(intraday)", "m": "ts_sum20(intraday)"}


def row_review(spark, sf_dir):
    """Factors whose ranks correlate by 0.7 or more, also through others, and of each such group the one with the largest |IC|."""
    names = ["f", *_FACTORS]
    rows = base_rows(spark, sf_dir, extra=_FACTORS)
    nodes = ev.batch_ic(rows, names, 20).select(F.col("factor").alias("id"), F.abs("ic").alias("score"))
    return rp.review(nodes, cb.factor_similarity(rows, names), "score", 0.7)


def _row_review_sql() -> str:
    over = {w: _enough(f"avg(intraday) {line(w)}", w, "intraday") for w in (10, 20)}
    extra = f", -({_enough(f'avg(ret) {line(10)}', 10, 'ret')}) AS g, {over[10]} AS h, {over[20]} AS k"
    extra += f", {_enough(f'sum(intraday) {line(20)}', 20, 'intraday')} AS m"
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM q WHERE t % 5 = 0 AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY t HAVING count(*) >= 20"
        for i, a in enumerate("fghkm") for b in "fghkm"[i + 1 :]
    )
    scores = " UNION ALL ".join(
        f"SELECT '{c}' AS id, corr({c}, r) AS ic FROM q WHERE {c} IS NOT NULL AND r IS NOT NULL GROUP BY t HAVING count(*) >= 20" for c in "fghkm"
    )
    ranks = ", ".join(f"{ordinal(c)} AS {c}" for c in "fghkmr")
    return f"""{base_sql(extra=extra).replace('WITH ', 'WITH RECURSIVE ', 1)}, q AS (SELECT t, {ranks} FROM base),
n AS (SELECT id, abs(avg(ic)) AS score FROM ({scores}) GROUP BY id), sim AS (SELECT a, b FROM ({pairs}) GROUP BY a, b HAVING quantile_cont(abs(c), 0.5) >= 0.7),
l AS (SELECT a, b FROM sim UNION SELECT b, a FROM sim), reach(id, o) AS (SELECT id, id FROM n UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.o),
z AS (SELECT id, min(o) AS component FROM reach GROUP BY id)
SELECT n.id, component, count(*) OVER (PARTITION BY component) AS size,
       row_number() OVER (PARTITION BY component ORDER BY score DESC NULLS LAST, n.id) = 1 AS keep FROM n JOIN z ON z.id = n.id"""


# Libraries of factors: supplier figures stand for the records of factors, nations for their pools.


def library_views(spark, sf_dir):
    """Records joined to tags kept as text, own figures before others', and the last three of each pool."""
    m = supplier_metrics(spark, sf_dir).select(SYM, "industry", "pool", "calmar", "ic")
    tags = m.where("pool <> 2").select(
        F.concat(F.lit(" "), F.col(SYM).cast("string")).alias(SYM), F.when(F.col("calmar") > 0.3, "good").otherwise("poor").alias("tag"),
    )
    own = m.where(f"{SYM} % 3 <> 0").select(SYM, F.when(F.col(SYM) % 2 == 0, F.col("ic")).alias("ic"))
    merged = store.with_fallback(own, m.select(SYM, (F.col("ic") * 2).alias("ic")), [SYM])
    out = store.joined_results(m.drop("ic"), tags, [SYM]).join(merged, SYM)
    return rp.tail(out, ["pool"], SYM, 3).select(SYM, F.col("pool").cast("long").alias("pool"), "tag", rounded(F.col("ic")).alias("ic"))


_VIEWS = f"""{_METRICS}, k AS (SELECT m.sym, pool, CASE WHEN pool <> 2 THEN CASE WHEN calmar > 0.3 THEN 'good' ELSE 'poor' END END AS tag, CASE WHEN sym % 3 <> 0 AND sym % 2 = 0 AND ic IS NOT NULL THEN ic ELSE ic * 2 END AS ic, row_number() OVER (PARTITION BY pool ORDER BY sym DESC) AS k FROM metrics m)
SELECT sym, CAST(pool AS BIGINT) AS pool, tag, {r('ic')} AS ic FROM k WHERE k <= 3"""


def strip_audit(spark, sf_dir):
    """Library by pool and grade: how many factors, their mean figure, and which share a pruning of pure styles would take."""
    from ..operators import control

    m = supplier_metrics(spark, sf_dir).withColumn("grade", control.strip_grade(F.col("calmar") - 0.1, F.col("last_yr"), F.col("dd") + 0.7))
    per = m.groupBy("pool", "grade").agg(F.count("*").alias("n"), F.avg("calmar").alias("calmar"))
    total = m.groupBy("pool").agg(F.avg((F.col("grade") == "C").cast("int")).alias("pruned"))
    return per.join(total.withColumnRenamed("pool", "of"), F.col("pool").eqNullSafe(F.col("of"))).select(
        F.col("pool").cast("long").alias("pool"), "grade", "n", rounded(F.col("calmar")).alias("calmar"),
        rounded(F.col("pruned")).alias("pruned"),
    )


_AUDIT = f"""{_METRICS}, g AS (SELECT pool, calmar, CASE WHEN calmar IS NULL OR last_yr IS NULL THEN 'D' WHEN last_yr <= 0 OR calmar - 0.1 <= 0 THEN 'C' WHEN calmar - 0.1 >= 0.3 AND dd + 0.7 > -0.2 THEN 'A' ELSE 'B' END AS grade FROM metrics)
SELECT CAST(pool AS BIGINT) AS pool, grade, count(*) AS n, {r('avg(calmar)')} AS calmar, {r("(SELECT avg(CASE WHEN h.grade = 'C' THEN 1 ELSE 0 END) FROM g h WHERE h.pool IS NOT DISTINCT FROM g.pool)")} AS pruned FROM g GROUP BY pool, grade"""


def recent_rows(spark, sf_dir):
    """Rows of the last 40 dates by date; all where there are fewer than half as many."""
    rows = panels.lineitem_panel(spark, sf_dir)
    long_, short = store.recent(rows, 40, 20), store.recent(rows.where(f"{T} < 15"), 40, 20)
    count = lambda df, kind: df.groupBy(F.col(T).cast("long").alias(T)).agg(F.count("close").alias("n")).withColumn("kind", F.lit(kind))
    return count(long_, "recent").unionByName(count(short, "all"))


def _recent_sql() -> str:
    from .base import P2

    return f"WITH {P2} SELECT CAST(t AS BIGINT) AS t, count(close) AS n, 'recent' AS kind FROM panel WHERE t > (SELECT max(t) FROM panel) - 40 GROUP BY t UNION ALL SELECT CAST(t AS BIGINT), count(close), 'all' FROM panel WHERE t < 15 GROUP BY t"


QUERIES = {
    "neutralised_returns": (neutralised_returns, _NEUTRAL_RETURNS),
    "attribution": (attribution, _attribution_sql()),
    "neutral_ic": (neutral_ic, _neutral_ic_sql()),
    "pool_record": (pool_record, _POOL_RECORD),
    "strip_record": (strip_record, _STRIP_RECORD),
    "extra_strip": (extra_strip, _EXTRA),
    "metric_table": (metric_table, _metric_table_sql()),
    "decile_curves": (decile_curves, _CURVES),
    "style_years": (style_years, _style_years_sql()),
    "standard_report": (standard_report, _report_sql()),
    "combo_check": (combo_check, _combo_sql()),
    "row_review": (row_review, _row_review_sql()),
    "library_views": (library_views, _VIEWS),
    "strip_audit": (strip_audit, _AUDIT),
    "recent_rows": (recent_rows, _recent_sql()),
}

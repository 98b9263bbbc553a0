"""Reports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..operators import backtest as bt
from ..operators import combination as cb
from ..operators import evaluation as ev
from ..operators import reports as rp
from ..sources import panels
from .across import _neutral_two, base_rows, base_sql, left_over, ordinal, pct
from .base import P2, line, r
from .general import _STREAMS, streams
from .scoring import _DECILES, _LIMIT, _SHAPE_ROW, _corr, _metrics_sql, _per, _per_sql, _shown

_LINE = "OVER (PARTITION BY sym ORDER BY t)"


def style_strip(spark, sf_dir):
    """The backtest of what two styles leave of the factor."""
    rows = ev.neutralised(base_rows(spark, sf_dir), "f", "ln_mktcap", "ln_volume", "neutral", least=30).withColumn("f", F.col("neutral"))
    per = bt.periods(bt.trades(rows, limit=_LIMIT), least=30, least_top=2, least_pool=20)
    return _shown(bt.metrics(per), ("ann_ex", "dd", "calmar", "sharpe", "turn"), ("periods",))


def _stripped_rows(z1: str = "ln_mktcap", z2: str = "ln_volume") -> dict[str, str]:
    """The rows of a backtest whose factor is what two styles leave of it."""
    neutral = _neutral_two(z1, z2)[1].split(", s AS (", 1)[1].rsplit(" SELECT sym, CAST(t AS BIGINT)", 1)[0]
    return {
        "ctes": f", s AS ({neutral}, stripped AS (SELECT b.*, CASE WHEN e.n >= 30 THEN e.e END AS left_over FROM base b JOIN e ON e.sym = b.sym AND e.t = b.t)",
        "source": "stripped", "f": "left_over",
    }


def _strip_sql() -> str:
    return _metrics_sql(_per_sql(**_stripped_rows()))


def pool_restricted(spark, sf_dir):
    rows = rp.restricted(base_rows(spark, sf_dir), F.col("pool").isin(1, 2, 3))
    return _shown(ev.daily_ic(rows, 20), ("ic",), (T, "n"))


def _pool_sql() -> str:
    from .across import avg_rank

    return f"""{base_sql()}, i AS (SELECT t, r, CASE WHEN pool IN (1, 2, 3) THEN f END AS f FROM base), p AS (SELECT t, {avg_rank('f')} AS x, {avg_rank('r')} AS y FROM i WHERE f IS NOT NULL AND r IS NOT NULL)
SELECT CAST(t AS BIGINT) AS t, count(*) AS n, {r(_corr('x', 'y'))} AS ic FROM p GROUP BY t HAVING count(*) >= 20"""


_NET_COLS = (
    "stab", "turn_est", "turn_top", "d1", "d10", "sd_top", "top_ann", "spread_ann", "net_ann", "net_sharpe", "top20", "sd_top20",
    "top20_ann", "net20_ann", "net20_sharpe",
)


def net_of_cost(spark, sf_dir):
    rows = base_rows(spark, sf_dir)
    stab = ev.stability(rows, least=20).agg(F.avg("corr").alias("stab"))
    return _shown(rp.net_of_cost(ev.decile_shape(rows, least=30, least_in_bucket=2), stab, 0.002), _NET_COLS)


def _net_sql() -> str:
    stable = f"k1 AS (SELECT sym, t, x, lead(x) {_LINE} AS y FROM q0), st AS (SELECT avg(c) AS stab FROM (SELECT corr(x, y) AS c FROM k1 WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY t HAVING count(*) >= 20))"
    cols = {
        "stab": "stab", "turn_est": "1 - stab", "turn_top": "turn_top", "d1": "d1", "d10": "d10", "sd_top": "sd_top", "top_ann": "d1 * 252 / 5", "spread_ann": "(d1 - d10) * 252 / 5", "net_ann": "d1 * 50.4 - 0.004 * (1 - stab) * 50.4",
        "net_sharpe": "(d1 * 50.4 - 0.004 * (1 - stab) * 50.4) / (sd_top * sqrt(50.4))", "top20": "top20", "sd_top20": "sd_top20", "top20_ann": "top20 * 50.4", "net20_ann": "top20 * 50.4 - 0.004 * turn_top * 50.4",
        "net20_sharpe": "(top20 * 50.4 - 0.004 * turn_top * 50.4) / (sd_top20 * sqrt(50.4))",
    }
    return f"{_SHAPE_ROW}, {stable}\nSELECT {', '.join(f'{r(v)} AS {k}' for k, v in cols.items())} FROM shape, st"


def net_of_cost_neutral(spark, sf_dir):
    rows = base_rows(spark, sf_dir)
    stab = ev.stability(rows, least=20).agg(F.avg("corr").alias("stab"))
    out = rp.net_neutral(rows, ["ln_mktcap", "ln_volume"], stab, 0.002, least=30, least_in_bucket=2)
    return out.select(*[rounded(F.col(c), 5).alias(c) for c in ("d1_n", "sd_top_n", "net_n_ann", "net_n_sharpe", "ic_n")])


def _net_neutral_sql() -> str:
    w = "OVER (PARTITION BY t)"
    left = f"""base0 AS (SELECT * FROM raw WHERE t % 5 = 0), nb AS (SELECT sym, t, r, ln_mktcap AS x1, ln_volume AS x2 FROM base0 WHERE r IS NOT NULL AND ln_mktcap IS NOT NULL AND ln_volume IS NOT NULL),
nm AS (SELECT *, count(*) {w} AS n, var_pop(x1) {w} AS s11, var_pop(x2) {w} AS s22, covar_pop(x1, x2) {w} AS s12, covar_pop(r, x1) {w} AS s1, covar_pop(r, x2) {w} AS s2, avg(r) {w} AS my, avg(x1) {w} AS m1, avg(x2) {w} AS m2 FROM nb),
ne AS (SELECT sym, t, r - (my + (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2)) AS e FROM nm WHERE n >= 30),
base AS (SELECT b.* REPLACE (coalesce(e, b.r) AS r) FROM base0 b LEFT JOIN ne ON ne.sym = b.sym AND ne.t = b.t)"""
    shape = _SHAPE_ROW.replace(", base AS (", ", raw AS (", 1).replace(", q0 AS (", f", {left}, q0 AS (", 1)
    ics = f"iy AS (SELECT t, {ordinal('f')} AS x, {ordinal('r')} AS y FROM base), id AS (SELECT t, {_corr('x', 'y')} AS c FROM iy WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY t HAVING count(*) >= 30)"
    net = "(d1 * 50.4 - 0.004 * turn_top * 50.4)"
    return f"""{shape}, {ics}
SELECT {r('d1', 5)} AS d1_n, {r('sd_top', 5)} AS sd_top_n, {r(net, 5)} AS net_n_ann, {r(f'{net} / (sd_top * sqrt(50.4))', 5)} AS net_n_sharpe, {r('(SELECT abs(avg(c)) FROM id)', 5)} AS ic_n FROM shape"""


def long_short(spark, sf_dir):
    return _shown(rp.long_short(base_rows(spark, sf_dir), least=30, least_in_bucket=2), ("nav_top", "nav_bottom", "nav_spread"), (T,))


_o = "OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)"
_LONG_SHORT = f"""{_DECILES}, k AS (SELECT t, max(CASE WHEN d = 1 THEN ret END) AS a, max(CASE WHEN d = 10 THEN ret END) AS z FROM b GROUP BY t)
SELECT CAST(t AS BIGINT) AS t, {r(f'exp(sum(ln(1 + a)) {_o})')} AS nav_top, {r(f'exp(sum(ln(1 + z)) {_o})')} AS nav_bottom, {r(f'exp(sum(ln(1 + (a - z) / 2)) {_o})')} AS nav_spread FROM k WHERE a IS NOT NULL AND z IS NOT NULL"""


def exposures(spark, sf_dir):
    return _shown(rp.exposures(base_rows(spark, sf_dir), ["ln_mktcap", "ln_volume"]), ("ln_mktcap", "ln_volume"), (T, "n"))


_z = lambda c: f"({c} - avg({c}) OVER (PARTITION BY t)) / (stddev_samp({c}) OVER (PARTITION BY t) + 1e-12)"
_EXPOSURES = f"""{base_sql()}, g AS (SELECT t, {pct('f')} AS p, {_z('ln_mktcap')} AS a, {_z('ln_volume')} AS b FROM base WHERE t % 5 = 0)
SELECT CAST(t AS BIGINT) AS t, count(*) AS n, {r('avg(a)')} AS ln_mktcap, {r('avg(b)')} AS ln_volume FROM g WHERE p > 0.9 GROUP BY t"""


def style_profile(spark, sf_dir):
    out = rp.style_profile(base_rows(spark, sf_dir), ["ln_mktcap", "ln_volume", "turn_ratio"], least=20)
    return out.select(
        "style", F.col("n").cast("long").alias("n"),
        *[rounded(F.col(c)).alias(c) for c in ("mean", "abs_mean", "ir", "t_plain", "t_ar1", "win")],
    )


def _profile_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS style, t, {ordinal('f')} AS x, {ordinal(c)} AS y FROM base" for c in ("ln_mktcap", "ln_volume", "turn_ratio")
    )
    return f"""{base_sql()}, long AS ({parts}), d AS (SELECT style, t, {_corr('x', 'y')} AS c FROM long WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 20), l AS (SELECT *, lag(c) OVER (PARTITION BY style ORDER BY t) AS p FROM d),
k AS (SELECT style, count(c) AS n, avg(c) AS mean, avg(abs(c)) AS abs_mean, avg(c) / stddev_samp(c) AS ir, avg(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS win, corr(c, p) AS rho FROM l GROUP BY style)
SELECT style, n, {r('mean')} AS mean, {r('abs_mean')} AS abs_mean, {r('ir')} AS ir, {r('ir * sqrt(n)')} AS t_plain, {r('ir * sqrt(n * (1 - rho) / (1 + rho))')} AS t_ar1, {r('win')} AS win FROM k"""


_KINDS = {"raw": [], "size": ["ln_mktcap"], "all": ["ln_mktcap", "ln_volume"]}


def style_profiles(spark, sf_dir):
    out = rp.style_profiles(base_rows(spark, sf_dir), ["ln_mktcap", "ln_volume", "turn_ratio"], _KINDS, 30)
    return out.select(
        "kind", "style", F.col("n").cast("long").alias("n"),
        *[rounded(F.col(c), 5).alias(c) for c in ("mean", "abs_mean", "ir", "t_plain", "t_ar1", "win")],
    )


def _profiles_sql() -> str:
    parts = []
    for kind, held in _KINDS.items():
        given = "".join(f" AND {c} IS NOT NULL" for c in held)
        left = f"""k0 AS (SELECT sym, t, {ordinal('f')} AS y, {', '.join(f'{ordinal(c)} AS {c}' for c in _KINDS['all'])} FROM raw),
zv AS (SELECT sym, t, {left_over(held)} AS v, count(*) OVER (PARTITION BY t) AS m FROM k0 WHERE y IS NOT NULL{given}),
base AS (SELECT raw.* REPLACE (CASE WHEN m >= 30 THEN v END AS f) FROM raw LEFT JOIN zv ON zv.sym = raw.sym AND zv.t = raw.t)"""
        one = _profile_sql().replace(", base AS (", ", raw AS (", 1).replace("  FROM leaves\n)", f"  FROM leaves\n), {left}", 1).replace("HAVING count(*) >= 20", "HAVING count(*) >= 30")
        for c in ("mean", "abs_mean", "ir", "t_plain", "t_ar1", "win"):
            one = one.replace(f"* 1e6 + 0.5003) / 1e6 AS {c}", f"* 1e5 + 0.5003) / 1e5 AS {c}")
        parts.append(f"SELECT '{kind}' AS kind, * FROM ({one})")
    return " UNION ALL ".join(parts)


def cost_sweep(spark, sf_dir):
    out = rp.sweep({5: bt.trades(base_rows(spark, sf_dir), limit=_LIMIT)}, [0.0, 0.004, 0.007], least=30, least_top=2, least_pool=20)
    return out.select(
        "cost", F.col("periods").cast("long").alias("periods"), rounded(F.col("ann_ex")).alias("ann_ex"), rounded(F.col("dd")).alias("dd"),
        rounded(F.col("sharpe")).alias("sharpe"),
    )


def _sweep_sql() -> str:
    parts = []
    for cost in (0.0, 0.004, 0.007):
        parts.append(f"SELECT {cost}::DOUBLE AS cost, periods, ann_ex, dd, sharpe FROM ({_metrics_sql(_per_sql(cost=cost))})")
    return " UNION ALL ".join(parts)


def horizon_sweep(spark, sf_dir):
    traded = {f: bt.trades(base_rows(spark, sf_dir, f), step=f, limit=_LIMIT) for f in (3, 5)}
    out = rp.sweep(traded, [0.004], least=30, least_top=2, least_pool=20)
    return out.select(
        F.col("horizon").cast("long").alias("horizon"), F.col("periods").cast("long").alias("periods"),
        rounded(F.col("ann_ex")).alias("ann_ex"), rounded(F.col("turn")).alias("turn"),
    )


def _horizon_sql() -> str:
    parts = [
        f"SELECT CAST({f} AS BIGINT) AS horizon, periods, ann_ex, turn FROM ({_metrics_sql(_per_sql(step=f), step=f)})" for f in (3, 5)
    ]
    return " UNION ALL ".join(parts)


def daily_picks(spark, sf_dir):
    out = rp.picks(base_rows(spark, sf_dir), 60, 10, F.col("pool") != 4, _LIMIT)
    return out.select(
        SYM, F.col(T).cast("long").alias(T), F.col("place").cast("long").alias("place"), rounded(F.col("size_pct")).alias("size_pct"),
        rounded(F.col("tilt")).alias("tilt"),
    )


_PICKS = f"""{base_sql()}, b AS (SELECT *, lag(close) {_LINE} AS pc FROM base), c AS (SELECT *, lead(coalesce(close > 0 AND turnover > 0 AND (pc IS NULL OR close < pc * 1.5 - 1e-6), false), 1) {_LINE} AS can FROM b), d AS (SELECT *, {pct('mktcap')} AS size_pct FROM c WHERE t = 60 AND f IS NOT NULL AND pool <> 4 AND can),
e AS (SELECT *, row_number() OVER (ORDER BY f DESC, sym) AS place FROM d) SELECT sym, CAST(t AS BIGINT) AS t, place, {r('size_pct')} AS size_pct, {r('(SELECT quantile_cont(size_pct, 0.5) FROM e WHERE place <= 10)')} AS tilt FROM e WHERE place <= 10"""


def crowding(spark, sf_dir):
    out = rp.crowding(base_rows(spark, sf_dir), "turn_ratio")
    return _shown(out, ("ret", "win"), ("bucket", "days"))


_CROWDING = f"""{base_sql()}, d AS (SELECT t, avg(turn_ratio) AS c, avg(r) AS m FROM base GROUP BY t), k AS (SELECT *, ntile(5) OVER (ORDER BY c, t) AS bucket FROM d WHERE c IS NOT NULL AND m IS NOT NULL)
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS days, {r('avg(m)')} AS ret, {r('avg(CASE WHEN m > 0 THEN 1 ELSE 0 END)')} AS win FROM k GROUP BY bucket"""


def crowding_years(spark, sf_dir):
    days = base_rows(spark, sf_dir).groupBy(T).agg(F.max("date").alias("date"), F.avg("turn_ratio").alias("crowd"), F.avg("r").alias("ret"))
    return _shown(rp.crowding_years(days, 0.8, 0.3), ("ret_high", "ret_low", "ret", "spread"), ("year", "n_high", "n_low"))


_CROWD_YEARS = f"""{base_sql()}, d AS (SELECT t, any_value(date) AS date, avg(turn_ratio) AS c, avg(r) AS m FROM base GROUP BY t), k AS (SELECT date // 100 AS year, m, (rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0) / count(*) OVER () AS p FROM d WHERE c IS NOT NULL),
y AS (SELECT year, count(*) FILTER (WHERE p >= 0.8) AS n_high, avg(m) FILTER (WHERE p >= 0.8) AS a, count(*) FILTER (WHERE p <= 0.3) AS n_low, avg(m) FILTER (WHERE p <= 0.3) AS b, avg(m) AS m FROM k GROUP BY year)
SELECT CAST(year AS BIGINT) AS year, n_high, n_low, {r('a')} AS ret_high, {r('b')} AS ret_low, {r('m')} AS ret, {r('a - b')} AS spread FROM y WHERE n_high + n_low > 0"""


def eligible_ic(spark, sf_dir):
    rows = ev.eligible(base_rows(spark, sf_dir), 20, F.col("turnover") > 200_000)
    return _shown(ev.daily_ic(rows, 10), ("ic",), (T, "n"))


def _eligible_sql() -> str:
    from .across import avg_rank

    return f"""{base_sql()}, p AS (SELECT t, {avg_rank('f')} AS x, {avg_rank('r')} AS y FROM base WHERE f IS NOT NULL AND r IS NOT NULL AND t >= 20 AND turnover > 200000)
SELECT CAST(t AS BIGINT) AS t, count(*) AS n, {r(_corr('x', 'y'))} AS ic FROM p GROUP BY t HAVING count(*) >= 10"""


def breadth(spark, sf_dir):
    return _shown(rp.breadth(panels.lineitem_panel(spark, sf_dir)), ("above", "up", "high"), (T, "n"))


_BREADTH = f"""WITH {P2}, k AS (SELECT t, CAST(close > avg(close) {line(20)} AS INT) AS a, CAST(close > lag(close) {_LINE} AS INT) AS u, CAST(close >= max(close) {line(20)} AS INT) AS h FROM panel)
SELECT CAST(t AS BIGINT) AS t, count(a) AS n, {r('avg(a)')} AS above, {r('avg(u)')} AS up, {r('avg(h)')} AS high FROM k GROUP BY t"""


def strip_variants(spark, sf_dir):
    out = rp.strip_variants(base_rows(spark, sf_dir), "f", ["ln_mktcap", "ln_volume"], "pool", least=30)
    return out.select(SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(c)).alias(c) for c in "abc"])


_w = "OVER (PARTITION BY t)"
_STRIPS = f"""{base_sql()}, k0 AS (SELECT sym, t, pool, {ordinal('f')} AS y, {ordinal('ln_mktcap')} AS x1, {ordinal('ln_volume')} AS x2 FROM base), k AS (SELECT * FROM k0 WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (SELECT *, count(*) {_w} AS n, var_pop(x1) {_w} AS s11, var_pop(x2) {_w} AS s22, covar_pop(x1, x2) {_w} AS s12, covar_pop(y, x1) {_w} AS s1, covar_pop(y, x2) {_w} AS s2, avg(y) {_w} AS my, avg(x1) {_w} AS m1, avg(x2) {_w} AS m2 FROM k),
e AS (SELECT sym, t, y - (my + (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) * (x2 - m2)) AS b FROM m WHERE n >= 30),
j AS (SELECT k0.sym, k0.t, pool, y, b FROM k0 LEFT JOIN e ON e.sym = k0.sym AND e.t = k0.t)
SELECT sym, CAST(t AS BIGINT) AS t, {r('b - avg(b) OVER (PARTITION BY t, pool)')} AS a, {r('b')} AS b, {r('y - avg(y) OVER (PARTITION BY t, pool)')} AS c FROM j"""


def cross_review(spark, sf_dir):
    pairs = cb.stream_correlations(streams(spark, sf_dir)).select("a", "b", F.abs("corr").alias("similarity"))
    nodes = streams(spark, sf_dir).groupBy("id").agg(F.avg("x").alias("score"))
    return rp.review(nodes, pairs, "score", 0.25)


_REVIEW = f"""{_STREAMS.replace('WITH ', 'WITH RECURSIVE ', 1)}, n AS (SELECT id, avg(x) AS score FROM s GROUP BY id), l AS (SELECT a, b FROM c WHERE abs(corr) >= 0.25 UNION SELECT b, a FROM c WHERE abs(corr) >= 0.25),
reach(id, o) AS (SELECT id, id FROM n UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.o), q AS (SELECT id, min(o) AS component FROM reach GROUP BY id)
SELECT n.id, component, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component ORDER BY score DESC NULLS LAST, n.id) = 1 AS keep FROM n JOIN q ON q.id = n.id"""


def library_kpi(spark, sf_dir):
    """Mean absolute pairwise correlation, and the figures of the equal-weight composite beside the median member's."""
    st = streams(spark, sf_dir)
    pairs = cb.stream_correlations(st).agg(F.avg(F.abs("corr")).alias("mean_corr"))
    sharpe = lambda c: F.try_divide(F.avg(c), F.stddev_samp(c))
    members = st.groupBy("id").agg(sharpe("x").alias("s")).agg(F.percentile("s", F.lit(0.5)).alias("median_member"))
    whole = st.groupBy(T).agg(F.avg("x").alias("x")).agg(sharpe("x").alias("composite"))
    out = pairs.join(F.broadcast(members)).join(F.broadcast(whole))
    return _shown(out, ("mean_corr", "median_member", "composite"))


_KPI = f"""{_STREAMS}, m AS (SELECT avg(x) / stddev_samp(x) AS s FROM s GROUP BY id), w AS (SELECT avg(x) AS x FROM s GROUP BY t)
SELECT {r('(SELECT avg(abs(corr)) FROM c)')} AS mean_corr, {r('(SELECT quantile_cont(s, 0.5) FROM m)')} AS median_member, {r('(SELECT avg(x) / stddev_samp(x) FROM w)')} AS composite"""

QUERIES = {
    "style_strip": (style_strip, _strip_sql()),
    "strip_variants": (strip_variants, _STRIPS),
    "pool_restricted_ic": (pool_restricted, _pool_sql()),
    "net_of_cost": (net_of_cost, _net_sql()),
    "net_of_cost_neutral": (net_of_cost_neutral, _net_neutral_sql()),
    "long_short_curves": (long_short, _LONG_SHORT),
    "dynamic_exposure": (exposures, _EXPOSURES),
    "style_profile": (style_profile, _profile_sql()),
    "style_profiles": (style_profiles, _profiles_sql()),
    "cost_sweep": (cost_sweep, _sweep_sql()),
    "horizon_sweep": (horizon_sweep, _horizon_sql()),
    "daily_picks": (daily_picks, _PICKS),
    "crowding": (crowding, _CROWDING),
    "crowding_years": (crowding_years, _CROWD_YEARS),
    "eligible_ic": (eligible_ic, _eligible_sql()),
    "market_breadth": (breadth, _BREADTH),
    "cross_review": (cross_review, _REVIEW),
    "library_kpi": (library_kpi, _KPI),
}

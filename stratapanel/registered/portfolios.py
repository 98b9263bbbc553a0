"""Constrained portfolios, buffers and combinations, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cs
from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..operators import backtest as bt
from ..operators import combination as cb
from ..operators import portfolios as pf
from ..operators import selection
from ..operators.evaluation import on_grid
from ..sources import panels
from ..sources.shared import ensure_checkpoint_dir
from .across import base_rows, base_sql, ordinal, pct
from .along import _enough
from .base import LEAVES, P2, line, r
from .general import _STREAMS, streams


def _rows(spark, sf_dir):
    return base_rows(spark, sf_dir).withColumn("cap", F.col("mktcap")).withColumn("industry", F.when(F.col("pool") < 4, F.col("pool")))


_FLOATS = ("turn", "gross", "net", "even", "weighted", "size_pct", "industry_off", "overlap")


def constrained_plans(spark, sf_dir):
    held, pool = pf.holdings(_rows(spark, sf_dir), least_hold=12, least=30, max_w=0.08)
    out = pf.plan_periods(held, pool)
    return out.select("plan", F.col(T).cast("long").alias(T), "names", *[rounded(F.col(c)).alias(c) for c in _FLOATS])


def _resid(y: str, x: str) -> str:
    w = "OVER (PARTITION BY t)"
    return f"{y} - avg({y}) {w} - CASE WHEN var_pop({x}) {w} > 1e-12 THEN covar_pop({y}, {x}) {w} / var_pop({x}) {w} ELSE 0 END * ({x} - avg({x}) {w})"


def _plans_sql() -> str:
    even = lambda plan, test: f"SELECT '{plan}' AS plan, sym, t, r, g, size_pct, p0, 1 / count(*) OVER (PARTITION BY t)::DOUBLE AS w FROM k4 WHERE {test}"
    return f"""{base_sql()}, a AS (SELECT sym, t, f, r, mktcap AS cap, CASE WHEN pool < 4 THEN pool ELSE -1 END AS g, count(*) OVER (PARTITION BY t) AS n FROM base WHERE t % 5 = 0 AND f IS NOT NULL AND r IS NOT NULL),
b AS (SELECT *, greatest(floor(n * 0.1), 12) AS n_hold, CASE WHEN cap > 0 THEN cap ELSE 0 END / sum(CASE WHEN cap > 0 THEN cap ELSE 0 END) OVER (PARTITION BY t) AS w_cap, coalesce(CASE WHEN cap > 0 THEN ln(cap) END, avg(CASE WHEN cap > 0 THEN ln(cap) END) OVER (PARTITION BY t)) AS z, {pct('cap')} AS size_pct FROM a WHERE n >= 30),
c AS (SELECT *, {_resid('f', 'z')} AS m, f - avg(f) OVER (PARTITION BY t, g) AS fg, z - avg(z) OVER (PARTITION BY t, g) AS zg, CASE WHEN g >= 0 THEN round_even(n_hold * sum(w_cap) OVER (PARTITION BY t, g), 0) ELSE 0 END AS quota FROM b),
k1 AS (SELECT *, {_resid('fg', 'zg')} AS u FROM c),
k2 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f DESC, sym) <= n_hold AS p0, row_number() OVER (PARTITION BY t ORDER BY m DESC, sym) <= n_hold AS pm, row_number() OVER (PARTITION BY t, g ORDER BY f DESC, sym) <= quota AS q1, row_number() OVER (PARTITION BY t, g ORDER BY u DESC, sym) <= quota AS q2 FROM k1),
k4 AS (SELECT *, q1 AND row_number() OVER (PARTITION BY t ORDER BY q1 DESC, f DESC, sym) <= n_hold AS p1, q2 AND row_number() OVER (PARTITION BY t ORDER BY q2 DESC, u DESC, sym) <= n_hold AS p2 FROM k2),
mine AS (SELECT t, g, count(*) / sum(count(*)) OVER (PARTITION BY t)::DOUBLE AS wi FROM k4 WHERE p0 AND g >= 0 GROUP BY t, g), bench AS (SELECT t, g, sum(w_cap) AS wb FROM k4 WHERE g >= 0 GROUP BY t, g), norm AS (SELECT t, g, wb / sum(wb) OVER (PARTITION BY t) AS wn FROM bench),
s05 AS (SELECT k.sym, k.t, k.r, k.g, k.size_pct, k.p0, wn / wi AS scale FROM k4 k LEFT JOIN mine ON mine.t = k.t AND mine.g = k.g LEFT JOIN norm ON norm.t = k.t AND norm.g = k.g WHERE k.p0),
two AS ({even('s2', 'p2')}),
held AS ({even('s0', 'p0')} UNION ALL SELECT 's05', sym, t, r, g, size_pct, p0, coalesce(scale / sum(scale) OVER (PARTITION BY t), 0) FROM s05 UNION ALL {even('m1', 'pm')} UNION ALL {even('s1', 'p1')} UNION ALL SELECT * FROM two
  UNION ALL SELECT 's3', sym, t, r, g, size_pct, p0, least(w, 0.08) / sum(least(w, 0.08)) OVER (PARTITION BY t) FROM two),
days AS (SELECT plan, t, count(*) AS names, sum(w * r) AS gross, avg(size_pct) AS size_pct, avg(CASE WHEN p0 THEN 1 ELSE 0 END) AS overlap, lag(t) OVER (PARTITION BY plan ORDER BY t) AS before FROM held GROUP BY plan, t),
kept AS (SELECT d.plan, d.t, count(*) AS kept FROM days d JOIN held x ON x.plan = d.plan AND x.t = d.t JOIN held y ON y.plan = d.plan AND y.t = d.before AND y.sym = x.sym GROUP BY ALL),
market AS (SELECT t, avg(r) AS even, sum(w_cap * r) AS weighted FROM k4 GROUP BY t), own AS (SELECT plan, t, g, sum(w) AS wi FROM held WHERE g >= 0 GROUP BY ALL),
off AS (SELECT d.plan, d.t, max(abs(coalesce(wi, 0) - wb)) AS industry_off FROM days d JOIN bench ON bench.t = d.t LEFT JOIN own ON own.plan = d.plan AND own.t = d.t AND own.g = bench.g GROUP BY ALL),
o AS (SELECT d.*, CASE WHEN before IS NULL THEN 1.0 ELSE 1 - coalesce(kept, 0) / names::DOUBLE END AS turn, even, weighted, industry_off FROM days d LEFT JOIN kept ON kept.plan = d.plan AND kept.t = d.t JOIN market ON market.t = d.t LEFT JOIN off ON off.plan = d.plan AND off.t = d.t)
SELECT plan, CAST(t AS BIGINT) AS t, names, {', '.join(f'{r(c)} AS {c}' for c in _FLOATS if c != 'net')}, {r('gross - turn * 0.004')} AS net FROM o"""


BUFFERS = [0.0, 0.25, 0.5]


def buffered(spark, sf_dir):
    out = pf.buffered(base_rows(spark, sf_dir), 8, BUFFERS, "f", "pool")
    return out.groupBy("buffer", F.col("pool").cast("long").alias("pool"), F.col(T).cast("long").alias(T)).agg(
        F.count("*").alias("held"), F.sum(F.col("stayed").cast("long")).alias("stayed"),
        F.md5(F.array_join(F.sort_array(F.collect_list(F.col(SYM).cast("string"))), ",")).alias("names"),
    )


def _walk_sql(tail: str) -> str:
    return f"""{base_sql().replace('WITH ', 'WITH RECURSIVE ', 1)}, ranked AS (SELECT pool, t, sym, row_number() OVER (PARTITION BY pool, t ORDER BY f DESC, sym) AS place FROM base WHERE t % 5 = 0 AND f IS NOT NULL),
days AS (SELECT buffer, pool, t, list(sym ORDER BY place) AS names, row_number() OVER (PARTITION BY buffer, pool ORDER BY t) AS i FROM ranked, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BUFFERS)}) x(buffer) WHERE place <= floor(8 * (1 + buffer)) GROUP BY buffer, pool, t),
walk AS (
  SELECT buffer, pool, t, i, names[1:8] AS held, CAST(0 AS BIGINT) AS stayed FROM days WHERE i = 1
  UNION ALL
  SELECT d.buffer, d.pool, d.t, d.i, list_concat(list_filter(d.names, lambda s: list_contains(w.held, s)), list_filter(d.names, lambda s: NOT list_contains(w.held, s)))[1:8], CAST(least(8, len(list_filter(d.names, lambda s: list_contains(w.held, s)))) AS BIGINT)
  FROM walk w JOIN days d ON d.buffer = w.buffer AND d.pool = w.pool AND d.i = w.i + 1
) {tail}"""


_BUFFERED = _walk_sql(
    "SELECT buffer, CAST(pool AS BIGINT) AS pool, CAST(t AS BIGINT) AS t, CAST(len(held) AS BIGINT) AS held, stayed, md5(array_to_string(list_sort(list_transform(held, lambda s: CAST(s AS VARCHAR))), ',')) AS names FROM walk"
)


def buffer_sweep(spark, sf_dir):
    """Mean turnover and mean return of each buffer over pools and dates."""
    rows = base_rows(spark, sf_dir)
    held = pf.buffered(rows, 8, BUFFERS, "f", "pool").join(rows.select(SYM, T, "r"), [SYM, T])
    per = held.groupBy("buffer", "pool", T).agg((1 - F.avg(F.col("stayed").cast("double"))).alias("turn"), F.avg("r").alias("ret"))
    return per.groupBy("buffer").agg(
        F.count("*").alias("periods"), rounded(F.avg("turn")).alias("turn"), rounded(F.avg("ret")).alias("ret"),
    )


_SWEEP = _walk_sql(f""", flat AS (SELECT buffer, pool, t, len(held) AS n, stayed, unnest(held) AS sym FROM walk), per AS (SELECT buffer, pool, flat.t, 1 - any_value(stayed) / any_value(n)::DOUBLE AS turn, avg(r) AS ret FROM flat JOIN base b USING (sym, t, pool) GROUP BY ALL)
SELECT buffer, count(*) AS periods, {r('avg(turn)')} AS turn, {r('avg(ret)')} AS ret FROM per GROUP BY buffer""")


def unlike_known(spark, sf_dir):
    rows = base_rows(spark, sf_dir, extra={"g": "neg(ts_mean10(ret))", "h": "ts_mean10(intraday)", "k": "ts_mean20(intraday)"})
    out = pf.unlike_known(rows, ["f", "g"], ["h", "k"], 0.4)
    return out.select("factor", rounded(F.col("likeness")).alias("likeness"), "like", "new")


def _unlike_sql() -> str:
    extra = f", -({_enough(f'avg(ret) {line(10)}', 10, 'ret')}) AS g, {_enough(f'avg(intraday) {line(10)}', 10, 'intraday')} AS h, {_enough(f'avg(intraday) {line(20)}', 20, 'intraday')} AS k"
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM q WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY t HAVING count(*) >= 20" for a in "fg" for b in "hk"
    )
    return f"""{base_sql(extra=extra)}, q AS (SELECT t, {', '.join(f'{ordinal(c)} AS {c}' for c in 'fghk')} FROM base WHERE t % 5 = 0), m AS (SELECT a, b, quantile_cont(abs(c), 0.5) AS likeness FROM ({pairs}) GROUP BY a, b)
SELECT a AS factor, {r('max(likeness)')} AS likeness, arg_max(b, (likeness, b)) AS "like", max(likeness) < 0.4 AS new FROM m GROUP BY a"""


def unlike_weights(spark, sf_dir):
    """Even weights of return streams that are unlike each other, evaluated every 20 rows."""
    return pf.unlike_weights(streams(spark, sf_dir), 20, 40, 20, 0.1).select(F.col(T).alias(T), "id", rounded(F.col("w")).alias("w"))


_WEIGHTS = f"""{_STREAMS.replace('WITH ', 'WITH RECURSIVE ', 1)}, d AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM s)),
ev AS (SELECT k * 20 AS ep, (SELECT max(i) FROM d WHERE d.t < k * 20) AS upto FROM range(0, (SELECT CAST(max(t) // 20 + 2 AS BIGINT) FROM d)) x(k)),
v AS (SELECT ep, id, s.t, x FROM ev JOIN d ON d.i > upto - 40 AND d.i <= upto JOIN s ON s.t = d.t WHERE upto >= 20),
sc AS (SELECT ep, id, coalesce(CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) END, -9) AS score FROM v GROUP BY ep, id),
vp AS (SELECT l.ep, l.id AS a, q.id AS b, l.x AS xa, q.x AS xb FROM v l JOIN v q ON l.ep = q.ep AND l.t = q.t AND l.id <> q.id),
vr AS (SELECT ep, a, b, rank() OVER (PARTITION BY ep, a, b ORDER BY xa) + (count(*) OVER (PARTITION BY ep, a, b, xa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY ep, a, b ORDER BY xb) + (count(*) OVER (PARTITION BY ep, a, b, xb) - 1) / 2.0 AS rb FROM vp),
near AS (SELECT ep, a, list(b) AS near FROM (SELECT ep, a, b FROM vr GROUP BY ep, a, b HAVING abs(covar_pop(ra, rb)) >= 0.1 * sqrt(var_pop(ra) * var_pop(rb)) AND var_pop(ra) * var_pop(rb) > 0) GROUP BY ep, a),
o AS (SELECT sc.ep, sc.id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY sc.ep ORDER BY score DESC, CAST(sc.id AS VARCHAR)) AS i FROM sc LEFT JOIN near ON near.ep = sc.ep AND near.a = sc.id),
walk AS (
  SELECT DISTINCT ep, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids FROM o
  UNION ALL
  SELECT w.ep, o.i, CASE WHEN list_has_any(o.near, w.ids) THEN w.ids ELSE list_append(w.ids, o.id) END FROM walk w JOIN o ON o.ep = w.ep AND o.i = w.i + 1
), best AS (SELECT ep, arg_max(ids, i) AS ids FROM walk GROUP BY ep)
SELECT CAST(ep AS BIGINT) AS t, unnest(ids) AS id, {r('1.0::DOUBLE / len(ids)')} AS w FROM best"""


def combine_choice(spark, sf_dir):
    """Four factors combined by the streams of their best names that are unlike each other, evaluated every ten months, and the backtest of it beside
    that of even weights; weights, combination and record are tested on their own."""
    ensure_checkpoint_dir(spark)
    names = ["f", "g", "h", "k"]
    rows = base_rows(spark, sf_dir, extra={"g": "neg(ts_mean10(ret))", "h": "ts_mean10(intraday)", "k": "neg(ts_std20(ret))"})
    # schemes differ in the factor alone, so trades are made once, and with the ranks are kept
    ranks = bt.trades(rows).withColumns({c: cs.cs_rank(F.col(c)) for c in names}).select(SYM, T, "date", "r", "can", "ret", "cap", *names).checkpoint()
    best = [F.avg(F.when(F.col(c) > 0.8, F.col("r"))) - F.avg("r") for c in names]
    per = on_grid(ranks, 1).where("r is not null").groupBy(T).agg(*[b.alias(c) for b, c in zip(best, names, strict=True)])
    streams_ = per.select(T, F.explode(F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).alias("x")) for c in names])).alias("s")).select("s.id", F.col(T).cast("long").alias(T), "s.x").where("x is not null")
    weights = pf.unlike_weights(streams_, 10, 40, 10, 0.5)
    grid = on_grid(ranks)
    schemes = {"choice": cb.combine_by_choice(grid, weights, names), "even": cb.combine_equal(grid, names)}
    out = None
    for name, made in schemes.items():
        found = bt.record(made.withColumn("f", cs.cs_rank(F.col("combo"))), daily=False, least=30, least_top=3, least_pool=20, least_periods=3).select(F.lit(name).alias("scheme"), *[rounded(F.col(c)).alias(c) for c in ("ann_ex", "calmar", "sharpe", "dd", "turn")])
        out = found if out is None else out.unionByName(found)
    return out


def supplier_streams(spark, sf_dir):
    panel = panels.with_leaves(panels.lineitem_panel(spark, sf_dir))
    return panel.where("ret is not null").select(F.col(SYM).cast("long").alias("id"), T, F.col("ret").alias("x"))


def admission(spark, sf_dir):
    """Suppliers' monthly returns let in by mean over deviation: none like one that is in, at most four per nation; two nations are barred, the first
    two suppliers are in from the start."""
    ensure_checkpoint_dir(spark)
    streams_ = supplier_streams(spark, sf_dir).checkpoint()
    nation = panels.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").alias("skeleton"))
    score = F.floor(F.try_divide(F.avg("x"), F.stddev_samp("x")) * 1e6).cast("double")
    nodes = streams_.groupBy("id").agg(score.alias("score")).join(nation, "id")
    low = nodes.agg(F.min("id").alias("low"))
    held = F.col("id") <= F.col("low") + 1
    nodes = nodes.join(F.broadcast(low)).withColumns({"held": held, "barred": ~held & F.col("skeleton").isin(3, 7)})
    return selection.admit_streams(nodes, streams_, 0.3, 20, 4)


_ADMISSION = f"""WITH RECURSIVE {P2}, {LEAVES}, s AS (SELECT CAST(sym AS BIGINT) AS id, t, ret AS x FROM leaves WHERE ret IS NOT NULL),
p AS (SELECT l.id AS a, q.id AS b, l.x AS xa, q.x AS xb FROM s l JOIN s q ON l.t = q.t AND l.id < q.id),
k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0 AS rb FROM p),
c AS (SELECT a, b FROM k GROUP BY a, b HAVING count(*) >= 20 AND abs(covar_pop(ra, rb)) > 0.3 * sqrt(var_pop(ra) * var_pop(rb))),
n AS (SELECT id, any_value(s_nationkey) AS skeleton, floor(avg(x) / stddev_samp(x) * 1e6) AS score FROM s JOIN supplier ON s_suppkey = id GROUP BY id),
h AS (SELECT *, id <= (SELECT min(id) + 1 FROM n) AS held FROM n),
o AS (SELECT *, NOT held AND skeleton IN (3, 7) AS barred, row_number() OVER (ORDER BY held DESC, score DESC NULLS LAST, id) AS i,
      list_concat(coalesce((SELECT list(b) FROM c WHERE a = h.id), []), coalesce((SELECT list(a) FROM c WHERE b = h.id), [])) AS near FROM h),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids, CAST([] AS INT[]) AS kinds, CAST(NULL AS BIGINT) AS id, FALSE AS admitted, CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT i, CASE WHEN why IS NULL THEN list_append(ids, id) ELSE ids END, CASE WHEN why IS NULL THEN list_append(kinds, skeleton) ELSE kinds END, id, why IS NULL, why FROM (
    SELECT o.i, w.ids, w.kinds, o.id, o.skeleton, CASE WHEN held THEN NULL WHEN barred THEN 'barred' WHEN len(list_filter(w.kinds, lambda z: z = o.skeleton)) >= 4 THEN 'full' WHEN list_has_any(near, w.ids) THEN 'like' END AS why
    FROM walk w JOIN o ON o.i = w.i + 1)
) SELECT id, admitted, reason FROM walk WHERE i > 0"""


QUERIES = {
    "admission": (admission, _ADMISSION),
    "constrained_plans": (constrained_plans, _plans_sql()),
    "buffered_portfolio": (buffered, _BUFFERED),
    "buffer_sweep": (buffer_sweep, _SWEEP),
    "unlike_known": (unlike_known, _unlike_sql()),
    "unlike_weights": (unlike_weights, _WEIGHTS),
    "combine_choice": (combine_choice, None),
}

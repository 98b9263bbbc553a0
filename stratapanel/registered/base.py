"""What the registered queries share: the panels, and the same panels in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..plans.compiler import evaluate
from ..plans.expr import parse
from ..sources import panels

Query = Callable[[SparkSession, str], DataFrame]

P2 = """
items AS (
  SELECT l_suppkey AS sym, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, l_extendedprice / l_quantity AS p, l_quantity, l_extendedprice,
         row(l_shipdate, l_orderkey, l_linenumber) AS stamp FROM lineitem
), lim AS (SELECT min(m) AS lo, max(m) AS hi FROM items),
cells AS (
  SELECT sym, m - (SELECT lo FROM lim) AS t, sum(l_extendedprice) / sum(l_quantity) AS close, arg_min(p, stamp) AS open, max(p) AS high, min(p) AS low,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover FROM items GROUP BY ALL
), grid AS (
  SELECT s_suppkey AS sym, s_nationkey AS industry, n_regionkey AS pool, t FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
  CROSS JOIN range(0, (SELECT hi - lo + 1 FROM lim)) r(t)
), panel AS (
  SELECT g.sym, g.t, industry, pool, close, open, high, low, volume, turnover,
         CAST((g.t + (SELECT lo FROM lim)) // 12 * 100 + (g.t + (SELECT lo FROM lim)) % 12 + 1 AS INT) AS date,
         sum(turnover) OVER (PARTITION BY g.sym ORDER BY g.t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mktcap
  FROM grid g LEFT JOIN cells c ON c.sym = g.sym AND c.t = g.t
)"""

P1 = """
items AS (
  SELECT user_id AS sym, CAST(ts AS DATE) AS d, value, row(ts, event_id) AS stamp FROM events
), lim AS (SELECT min(d) AS lo, max(d) AS hi FROM items),
cells AS (
  SELECT sym, CAST(d - (SELECT lo FROM lim) AS INT) AS t, arg_max(value, stamp) AS close, arg_min(value, stamp) AS open, max(value) AS high, min(value) AS low,
         CAST(count(*) AS DOUBLE) AS volume, sum(value) AS turnover FROM items GROUP BY ALL
), grid AS (
  SELECT sym, t FROM (SELECT DISTINCT sym FROM items) CROSS JOIN range(0, (SELECT CAST(hi - lo AS INT) + 1 FROM lim)) r(t)
), panel AS (
  SELECT g.sym, g.t, close, open, high, low, volume, turnover,
         CAST(strftime((SELECT lo FROM lim) + CAST(g.t AS INT), '%Y%m%d') AS INT) AS date,
         sum(turnover) OVER (PARTITION BY g.sym ORDER BY g.t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mktcap
  FROM grid g LEFT JOIN cells c ON c.sym = g.sym AND c.t = g.t
)"""

P3 = """
items AS (
  SELECT s_nationkey AS sym, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS p, l_quantity, l_extendedprice,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS stamp FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), lim AS (SELECT min(d) AS lo, max(d) AS hi FROM items),
cells AS (
  SELECT sym, CAST(d - (SELECT lo FROM lim) AS INT) AS t, sum(l_extendedprice) / sum(l_quantity) AS close, arg_min(p, stamp) AS open, max(p) AS high,
         min(p) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover FROM items GROUP BY ALL
), grid AS (
  SELECT sym, t FROM (SELECT DISTINCT sym FROM items) CROSS JOIN range(0, (SELECT CAST(hi - lo AS INT) + 1 FROM lim)) r(t)
), panel AS (
  SELECT g.sym, g.t, close, open, high, low, volume, turnover,
         sum(turnover) OVER (PARTITION BY g.sym ORDER BY g.t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mktcap
  FROM grid g LEFT JOIN cells c ON c.sym = g.sym AND c.t = g.t
)"""

LEAVES = """
leaves AS (
  SELECT *, turnover / greatest(volume, 1e-9) AS vwap, close / pc - 1 AS ret,
         CASE WHEN mktcap IS NOT NULL THEN turnover / greatest(mktcap, 1e-9) END AS turn_ratio,
         CASE WHEN mktcap IS NOT NULL THEN ln(greatest(mktcap, 1e-9)) END AS ln_mktcap, CASE WHEN volume IS NOT NULL THEN ln(greatest(volume, 1e-9)) END AS ln_volume,
         open / pc - 1 AS overnight, close / open - 1 AS intraday, (high - low) / pc AS amplitude,
         CASE WHEN high - low > 1e-9 THEN (high - greatest(open, close)) / (high - low) END AS up_shadow,
         CASE WHEN high - low > 1e-9 THEN (least(open, close) - low) / (high - low) END AS down_shadow, high / low AS hl_ratio,
         CASE WHEN pc IS NOT NULL AND close IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) / pc END AS true_range
  FROM (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY t) AS pc FROM panel)
)"""


def r(sql: str, digits: int = 6) -> str:
    return f"floor(({sql}) * 1e{digits} + 0.5003) / 1e{digits}"


def line(w: int) -> str:
    return f"OVER (PARTITION BY sym ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def panel_of(kind: str) -> Query:
    return {"P1": panels.events_panel, "P2": panels.lineitem_panel, "P3": panels.shipping_panel}[kind]


_PANELS = {"P1": P1, "P2": P2, "P3": P3}


def expressions(kind: str, texts: dict[str, str], sql: dict[str, str], digits: int = 6, leaves: bool = False) -> tuple[Query, str]:
    """A query of expressions over a panel and the SQL with one expression for each; both give (sym, t, expressions)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = panel_of(kind)(spark, sf_dir)
        panel = panels.with_leaves(panel) if leaves else panel
        made = evaluate(panel, {k: parse(v) for k, v in texts.items()})
        return made.select(SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(k), digits).alias(k) for k in texts])

    base = _PANELS[kind] + ("," + LEAVES if leaves else "")
    source = "leaves" if leaves else "panel"
    cols = ", ".join(f"{r(v, digits)} AS {k}" for k, v in sql.items())
    return run, f"WITH RECURSIVE {base}\nSELECT sym, CAST(t AS BIGINT) AS t, {cols} FROM {source}"

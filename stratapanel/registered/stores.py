"""Reports known at a date, trailing years, bars, scaled flows, quantised copies and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..sources import panels, store
from ..sources.shared import shared_folder
from ..streaming import bars
from .base import P2, r


def _reports(spark, sf_dir):
    """Year-to-date sales per supplier and quarter; each quarter is announced one to three months after its end."""
    items = panels.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(SYM), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), "l_extendedprice",
    )
    per = items.groupBy(SYM, "y", "q").agg(F.sum("l_extendedprice").alias("own"))
    ytd = per.alias("a").join(
        per.alias("b"), (F.col("a.sym") == F.col("b.sym")) & (F.col("a.y") == F.col("b.y")) & (F.col("b.q") <= F.col("a.q")),
    )
    ytd = ytd.groupBy(F.col("a.sym").alias(SYM), F.col("a.y").alias("y"), F.col("a.q").alias("q")).agg(F.sum("b.own").alias("sales"))
    month = F.col("y") * 12 + F.col("q") * 3 + (F.col(SYM) + F.col("q")) % 3
    return ytd.select(SYM, (F.col("y") * 4 + F.col("q") - 1).cast("long").alias("quarter"), month.cast("long").alias("info_date"), "sales")


_REPORTS = """WITH RECURSIVE per AS (SELECT l_suppkey AS sym, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(l_extendedprice) AS own FROM lineitem GROUP BY ALL),
reports AS (SELECT a.sym, CAST(a.y * 4 + a.q - 1 AS BIGINT) AS quarter, CAST(a.y * 12 + a.q * 3 + (a.sym + a.q) % 3 AS BIGINT) AS info_date, sum(b.own) AS sales FROM per a JOIN per b ON a.sym = b.sym AND a.y = b.y AND b.q <= a.q GROUP BY a.sym, a.y, a.q)"""


def point_in_time(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    dates = panels.lineitem_panel(spark, sf_dir).select(
        SYM, (F.floor(F.col("date") / 100) * 12 + F.col("date") % 100 - 1).cast("long").alias("date"),
    )
    out = store.point_in_time(reports, dates, ["sales"])
    return out.select(SYM, "date", "known_quarter", rounded(F.col("sales"), 2).alias("sales"))


_PIT = f"""{_REPORTS}, {P2.strip()}, d AS (SELECT sym, CAST(date // 100 * 12 + date % 100 - 1 AS BIGINT) AS date FROM panel),
k AS (SELECT d.sym, d.date, max(quarter) AS known_quarter, arg_max(sales, (quarter, info_date)) AS sales FROM d LEFT JOIN reports p ON p.sym = d.sym AND p.info_date < d.date GROUP BY d.sym, d.date)
SELECT sym, date, known_quarter, {r('sales', 2)} AS sales FROM k"""


def trailing_year(spark, sf_dir):
    out = store.trailing_year(_reports(spark, sf_dir), "sales")
    return out.select(SYM, "quarter", rounded(F.col("ttm"), 2).alias("ttm"))


_TTM = f"""{_REPORTS} SELECT a.sym, a.quarter, {r('a.sales + (SELECT y.sales FROM reports y WHERE y.sym = a.sym AND y.quarter = (a.quarter // 4) * 4 - 1) - (SELECT b.sales FROM reports b WHERE b.sym = a.sym AND b.quarter = a.quarter - 4)', 2)} AS ttm
FROM reports a"""


def event_bars(spark, sf_dir):
    events = panels.read(spark, sf_dir, "events").where("value is not null")
    out = bars.bars(events)
    return out.select(
        "sym", F.date_format("start", "yyyyMMdd").cast("int").alias("day"), "high", "low", "volume",
        rounded(F.col("turnover"), 3).alias("turnover"),
    )


_BARS = f"""SELECT user_id AS sym, CAST(strftime(ts, '%Y%m%d') AS INT) AS day, max(value) AS high, min(value) AS low, count(*) AS volume, {r('sum(value)', 3)} AS turnover FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""


def scaled_flows(spark, sf_dir):
    panel = panels.lineitem_panel(spark, sf_dir).select(SYM, T, "date", "close")
    flow = panel.where((F.col(T) + F.col(SYM)) % 3 == 0).select(
        SYM, "date", (F.col("close") / 1000).alias("mf_s_buy"), (F.col(T) * 1.0).alias("mf_s_bqty"),
    )
    out = store.money_flow_leaves(flow, panel, ["mf_s_buy"], ["mf_s_bqty"])
    return out.select(
        SYM, F.col(T).cast("long").alias(T), rounded(F.col("mf_s_buy"), 4).alias("mf_s_buy"),
        rounded(F.col("mf_s_bqty"), 4).alias("mf_s_bqty"),
    )


_FLOWS = f"""WITH {P2} SELECT sym, CAST(t AS BIGINT) AS t, {r('CASE WHEN close IS NOT NULL THEN coalesce(CASE WHEN (t + sym) % 3 = 0 THEN close / 1000 * 10000 END, 0) END', 4)} AS mf_s_buy,
{r('CASE WHEN close IS NOT NULL THEN CASE WHEN (t + sym) % 3 = 0 THEN t * 100.0 ELSE 0 END END', 4)} AS mf_s_bqty FROM panel"""


def quantised(spark, sf_dir):
    values = panels.lineitem_panel(spark, sf_dir).select(SYM, T, F.col("close").alias("value"))
    return store.quantised(values).select(SYM, F.col(T).cast("long").alias(T), F.col("code").cast("long").alias("code"))


_QUANTISED = f"""WITH {P2} SELECT sym, CAST(t AS BIGINT) AS t, CAST(CASE WHEN close IS NOT NULL AND count(close) OVER (PARTITION BY t) >= 2 THEN
least(floor((row_number() OVER (PARTITION BY t ORDER BY close NULLS LAST, sym) - 1) * 256 / (count(close) OVER (PARTITION BY t))::DOUBLE), 255) END AS BIGINT) AS code FROM panel"""


def upserted(spark, sf_dir):
    o = panels.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").select(
        "o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
    )
    return store.upserted(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


_UPSERT = """WITH n AS (SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n"""

def kept_panel(spark, sf_dir):
    """Two columns of a panel that is written once with a digest of its source and read back pruned."""
    path = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    mark = store.fingerprint(spark, [f"{sf_dir}/lineitem.parquet"], panels.lineitem_panel)
    store.keep_panel(panels.lineitem_panel(spark, sf_dir), path, mark)
    out = store.open_panel(spark, path, mark, ["close", "turnover"])
    return out.select(
        SYM, F.col(T).cast("long").alias(T), rounded(F.col("close"), 3).alias("close"), rounded(F.col("turnover"), 3).alias("turnover"),
    )


_KEPT = f"WITH {P2} SELECT sym, CAST(t AS BIGINT) AS t, {r('close', 3)} AS close, {r('turnover', 3)} AS turnover FROM panel"

QUERIES = {
    "kept_panel": (kept_panel, _KEPT),
    "point_in_time": (point_in_time, _PIT),
    "trailing_year": (trailing_year, _TTM),
    "event_bars": (event_bars, _BARS),
    "scaled_flows": (scaled_flows, _FLOWS),
    "quantised_copy": (quantised, _QUANTISED),
    "upsert": (upserted, _UPSERT),
}

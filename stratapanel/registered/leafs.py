"""Leaves from flows, styles, reports and disclosures, registered with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..functions.ts import SYM, T
from ..sources import leaves, panels, store
from .base import P2, r

_D = "CAST(l_suppkey AS BIGINT)"


def _month() -> F.Column:
    return (F.floor(F.col("date") / 100) * 12 + F.col("date") % 100 - 1).cast("long")


def _panel(spark, sf_dir):
    """The monthly panel with ``date`` as a running month."""
    return panels.lineitem_panel(spark, sf_dir).select(SYM, T, _month().alias("date"), "close", "turnover", "mktcap")


_MONTHS = f"{P2}, mp AS (SELECT sym, t, CAST(date // 100 * 12 + date % 100 - 1 AS BIGINT) AS date, close, turnover, mktcap FROM panel)"


def flow_leaves(spark, sf_dir):
    """Flows of two order sizes, scaled and filled, and their reconciliation on every row."""
    panel = panels.lineitem_panel(spark, sf_dir).select(SYM, T, "date", "close")
    raw = {f"mf_{z}_{side}": F.col("close") * (k + 1) / (1000.0 if side == "buy" else 1010.0) for k, z in enumerate(leaves.SIZES) for side in leaves.SIDES}
    flow = panel.where((F.col(T) + F.col(SYM)) % 3 == 0).select(SYM, "date", *[c.alias(k) for k, c in raw.items()])
    made = store.money_flow_leaves(flow, panel, list(raw), [])
    out = made.crossJoin(leaves.flow_reconciliation(made))
    return out.select(
        SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(c), 3).alias(c) for c in ("mf_s_buy", "mf_x_sell")],
        rounded(F.col("gap")).alias("gap"),
    )


_FLOW = f"""WITH {P2}, f AS (SELECT sym, t, CASE WHEN close IS NULL THEN NULL WHEN (t + sym) % 3 = 0 THEN close ELSE 0 END AS c FROM panel), g AS (SELECT t, sum(c) * 10 / 1000.0 * 10000 AS b, sum(c) * 10 / 1010.0 * 10000 AS s FROM f GROUP BY t)
SELECT sym, CAST(t AS BIGINT) AS t, {r('c / 1000.0 * 10000', 3)} AS mf_s_buy, {r('c * 4 / 1010.0 * 10000', 3)} AS mf_x_sell, {r('(SELECT quantile_cont(abs(coalesce(b, 0) - coalesce(s, 0)) / greatest(coalesce(b, 0), 1), 0.5) FROM g)')} AS gap FROM f"""


def style_panel(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    rows = panel.where(F.col("close").isNotNull() & (F.col(T) % 4 != 1)).select(
        SYM, "date", F.explode(F.sequence(F.lit(0), F.col(T) % 2)).alias("seq"), F.col("close").alias("c"),
    )
    rows = rows.select(
        SYM, "date", "seq", (F.col("c") + F.col("seq")).alias("barra_size"), (F.col("c") * 2 - F.col("seq")).alias("barra_beta"),
    )
    out = leaves.style_leaves(panel, rows)
    return out.select(
        SYM, F.col(T).cast("long").alias(T), rounded(F.col("barra_size"), 3).alias("barra_size"),
        rounded(F.col("barra_beta"), 3).alias("barra_beta"), F.col("barra_growth").alias("barra_growth"),
    )


_STYLES = f"""WITH {P2} SELECT sym, CAST(t AS BIGINT) AS t, {r('CASE WHEN t % 4 <> 1 THEN close END', 3)} AS barra_size, {r('CASE WHEN t % 4 <> 1 THEN close * 2 END', 3)} AS barra_beta, CAST(NULL AS DOUBLE) AS barra_growth FROM panel"""


def _reports(spark, sf_dir):
    """Figures per supplier and quarter, announced one to three months after its end; some are announced again, higher."""
    i = panels.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(SYM), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), "l_extendedprice", "l_discount",
        "l_tax", "l_quantity",
    )
    s = lambda x: F.sum(x).cast("double")
    p = F.col("l_extendedprice")
    per = i.groupBy(SYM, "y", "q").agg(
        s(p).alias("rev"), s(p * (1 - F.col("l_discount"))).alias("gp"), s(p * F.col("l_tax")).alias("op"),
        s(p * F.col("l_discount")).alias("np"), s(F.col("l_quantity") * 100).alias("ocf"), F.count("*").cast("double").alias("n"),
    )
    per = per.select(
        SYM, (F.col("y") * 4 + F.col("q") - 1).cast("long").alias("quarter"), (
            F.col("y") * 12 + F.col("q") * 3 + (F.col(SYM) + F.col("q")) % 3
        ).cast("long").alias("info_date"), "np", "rev", "gp", "op", "ocf", (F.col("op") / 2).alias("sell_exp"),
        (F.col("n") * 1000).alias("equity"), (F.col("n") * 700).alias("liabilities"), (F.col("n") * 2000).alias("assets"), (F.col("n") * 10).alias("goodwill"), (F.col("n") - 1).alias("inventory"), (F.col("n") * 3).alias("receivable"), (F.col("np") * F.col("q")).alias("capex_ytd"),
    )
    again = per.where((F.col(SYM) + F.col("quarter")) % 4 == 0).withColumns(
        {"info_date": F.col("info_date") + 4, "np": F.col("np") * 1.1, "rev": F.col("rev") * 1.2}
    )
    return per.unionByName(again)


_REPORTS = """per AS (
  SELECT l_suppkey AS sym, year(l_shipdate) AS y, quarter(l_shipdate) AS q, CAST(sum(l_extendedprice) AS DOUBLE) AS rev, CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS gp, CAST(sum(l_extendedprice * l_tax) AS DOUBLE) AS op,
         CAST(sum(l_extendedprice * l_discount) AS DOUBLE) AS np, CAST(sum(l_quantity * 100) AS DOUBLE) AS ocf, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL
), one AS (SELECT sym, CAST(y * 4 + q - 1 AS BIGINT) AS quarter, CAST(y * 12 + q * 3 + (sym + q) % 3 AS BIGINT) AS info_date, np, rev, gp, op, ocf, op / 2 AS sell_exp, n * 1000 AS equity, n * 700 AS liabilities, n * 2000 AS assets, n * 10 AS goodwill, n - 1 AS inventory, n * 3 AS receivable, np * q AS capex_ytd FROM per),
rep AS (SELECT * FROM one UNION ALL SELECT sym, quarter, info_date + 4, np * 1.1, rev * 1.2, * EXCLUDE (sym, quarter, info_date, np, rev) FROM one WHERE (sym + quarter) % 4 = 0)"""

FINANCIAL = (
    "fa_np_yoy", "fa_rev_yoy", "fa_op_yoy", "fa_ocf_yoy", "fa_gm", "fa_np_margin", "fa_roe", "fa_lev", "fa_accrual", "fa_asset_turn",
    "fa_gw", "fa_inv_turn", "fa_recv_turn", "fa_sell_exp", "fa_ocf_ta", "fa_pb", "fa_fcf_yield",
)


def financial_leaves(spark, sf_dir):
    out = leaves.financial_leaves(_reports(spark, sf_dir), _panel(spark, sf_dir))
    return out.select(SYM, F.col(T).cast("long").alias(T), *[rounded(F.col(c), 5).alias(c) for c in FINANCIAL])


def _financial_sql() -> str:
    items = (
        "np", "rev", "gp", "op", "ocf", "sell_exp", "equity", "liabilities", "assets", "goodwill", "inventory", "receivable", "capex_ytd",
    )
    at = lambda name, quarter: f"{name} AS (SELECT k.sym, k.date, {', '.join(f'arg_max({c}, info_date) AS {c}' for c in items)} FROM k JOIN rep r ON r.sym = k.sym AND r.quarter = {quarter} AND r.info_date < k.date GROUP BY k.sym, k.date)"
    over = lambda a, b: f"CASE WHEN {b} <> 0 THEN {a} / {b} END"
    cols = {"fa_np_yoy": ("n.np", "o.np", -1), "fa_rev_yoy": ("n.rev", "o.rev", -1), "fa_op_yoy": ("n.op", "o.op", -1), "fa_ocf_yoy": ("n.ocf", "o.ocf", -1), "fa_gm": ("n.gp", "n.rev", 0), "fa_np_margin": ("n.np", "n.rev", 0), "fa_roe": ("n.np", "n.equity", 0),
            "fa_lev": ("n.liabilities", "n.assets", 0), "fa_accrual": ("n.ocf", "n.np", 0), "fa_asset_turn": ("n.rev", "n.assets", 0), "fa_gw": ("n.goodwill", "n.assets", 0), "fa_inv_turn": ("n.rev", "n.inventory", 0), "fa_recv_turn": ("n.rev", "n.receivable", 0),
            "fa_sell_exp": ("n.sell_exp", "n.rev", 0), "fa_ocf_ta": ("n.ocf", "n.assets", 0), "fa_pb": ("n.equity", "mp.mktcap", 0), "fa_fcf_yield": ("(n.ocf - (n.capex_ytd + e.capex_ytd - o.capex_ytd))", "mp.mktcap", 0)}
    return f"""WITH {_REPORTS}, {_MONTHS.strip()}, k AS (SELECT mp.sym, mp.date, max(quarter) AS q FROM mp JOIN rep ON rep.sym = mp.sym AND rep.info_date < mp.date GROUP BY ALL), {at('n', 'k.q')}, {at('o', 'k.q - 4')}, {at('e', '(k.q // 4) * 4 - 1')}
SELECT mp.sym, CAST(mp.t AS BIGINT) AS t, {', '.join(f"{r(f'{over(a, b)} + {c}', 5)} AS {k}" for k, (a, b, c) in cols.items())} FROM mp LEFT JOIN n ON n.sym = mp.sym AND n.date = mp.date LEFT JOIN o ON o.sym = mp.sym AND o.date = mp.date LEFT JOIN e ON e.sym = mp.sym AND e.date = mp.date"""


def alternative_leaves(spark, sf_dir):
    """Disclosures made of line items: by return flag and line number."""
    i = panels.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(SYM), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("long").alias("date"), "l_returnflag",
        "l_linenumber", "l_orderkey", F.col("l_extendedprice").cast("double").alias("p"), F.col("l_quantity").cast("double").alias("v"),
    )
    margin = i.where("l_linenumber = 1").select(
        SYM, "date", F.col("p").alias("balance"), F.when(F.col("v") > 10, F.col("v")).alias("bought"),
    )
    boards = i.where("l_linenumber = 2").select(
        SYM, "date", F.col("l_orderkey").alias("seq"), F.when(F.col("v") > 25, F.col("p")).alias("net"), F.col("p").alias("buy"),
        F.col("v").alias("sell"),
    )
    seats = i.where("l_returnflag = 'R'").select(SYM, "date", F.col("p").alias("buy"), F.col("v").alias("sell"))
    blocks = i.where("l_returnflag = 'A'").select(SYM, "date", F.col("v").alias("amount"))
    out = leaves.alternative_leaves(_panel(spark, sf_dir), margin, boards, seats, blocks)
    return out.select(
        SYM, F.col(T).cast("long").alias(T),
        *[rounded(F.col(c)).alias(c) for c in ("mg_bal_ratio", "mg_buy_ratio", "lhb_net_ratio", "lhb_inst_ratio", "block_vol_ratio")],
    )


_ALTERNATIVE = f"""WITH {_MONTHS.strip()}, i AS (SELECT l_suppkey AS sym, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS date, l_returnflag AS f, l_linenumber AS k, l_orderkey AS o, l_extendedprice::DOUBLE AS p, l_quantity::DOUBLE AS v FROM lineitem),
a AS (SELECT sym, date, sum(p) FILTER (WHERE k = 1) AS bal, sum(CASE WHEN v > 10 THEN v ELSE 0 END) FILTER (WHERE k = 1) AS buy, arg_max(CASE WHEN v > 25 THEN p ELSE p - v END, o) FILTER (WHERE k = 2) AS net, sum(p - v) FILTER (WHERE f = 'R') AS seat, sum(v) FILTER (WHERE f = 'A') AS block FROM i GROUP BY ALL)
SELECT mp.sym, CAST(t AS BIGINT) AS t, {r('bal / mktcap')} AS mg_bal_ratio, {r('buy / turnover')} AS mg_buy_ratio, {r('net / turnover')} AS lhb_net_ratio, {r('seat / turnover')} AS lhb_inst_ratio, {r('block / turnover')} AS block_vol_ratio FROM mp LEFT JOIN a ON a.sym = mp.sym AND a.date = mp.date"""


def industry_codes(spark, sf_dir):
    s = panels.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias(SYM),
        *[F.when(F.col("s_nationkey") % 5 == k, F.lit(0.6 if k else 0.4)).otherwise(F.when(F.col("s_nationkey") % 7 == 0, F.lit(None)).otherwise(0.1)).alias(f"i{k}") for k in range(4)],
    )
    return s.select(SYM, leaves.industry_code([f"i{k}" for k in range(4)]).cast("long").alias("code"))


_INDUSTRY = "SELECT s_suppkey AS sym, CAST(CASE WHEN s_nationkey % 5 IN (1, 2, 3) THEN s_nationkey % 5 ELSE -1 END AS BIGINT) AS code FROM supplier"


def index_closes(spark, sf_dir):
    """The orders of a status as an index: the first price of each day; and the last day at or before a given one."""
    o = panels.read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("index_id"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("double").alias("close"),
    )
    found = leaves.index_closes(o)
    last = store.latest_at(found.select(F.col("index_id"), "date"), ["index_id"], "date", 19950617).withColumnRenamed("date", "last_day")
    return found.join(last, "index_id", "left").select("index_id", "date", rounded(F.col("close"), 2).alias("close"), "last_day")


_INDEX = f"""WITH o AS (SELECT o_orderstatus AS index_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date, arg_min(o_totalprice, o_orderkey)::DOUBLE AS close FROM orders GROUP BY ALL)
SELECT o.index_id, date, {r('close', 2)} AS close, (SELECT max(date) FROM o b WHERE b.index_id = o.index_id AND b.date <= 19950617) AS last_day FROM o"""

QUERIES = {
    "flow_leaves": (flow_leaves, _FLOW),
    "style_panel": (style_panel, _STYLES),
    "financial_leaves": (financial_leaves, _financial_sql()),
    "alternative_leaves": (alternative_leaves, _ALTERNATIVE),
    "industry_codes": (industry_codes, _INDUSTRY),
    "index_closes": (index_closes, _INDEX),
}

"""Leaves that come from other tables than prices: money flows, styles, financial reports, trading disclosures, industry codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..functions.ts import SYM, T
from ..operators.combination import as_of
from ..plans.registry import LEAVES, STYLES

# The four order sizes and the two sides of money flows.
SIZES, SIDES = ("s", "m", "l", "x"), ("buy", "sell")
#: Figures of a report: trailing-year sums, balances, and capital spending of the year to date.
REPORT = ("np", "rev", "gp", "op", "ocf", "sell_exp", "equity", "liabilities", "assets", "goodwill", "inventory", "receivable", "capex_ytd")


def flow_reconciliation(panel: DataFrame) -> DataFrame:
    """Median over dates of |bought - sold| / bought, all sizes and symbols together: one row, ``gap``, near 0 for sound flows."""
    total = lambda side: sum((F.coalesce(F.sum(f"mf_{z}_{side}"), F.lit(0.0)) for z in SIZES[1:]), F.coalesce(F.sum(f"mf_{SIZES[0]}_{side}"), F.lit(0.0)))
    days = panel.groupBy(T).agg(total("buy").alias("b"), total("sell").alias("s"))
    return days.agg(F.percentile(F.abs(F.col("b") - F.col("s")) / F.greatest("b", F.lit(1.0)), F.lit(0.5)).alias("gap"))


def write_flows(rows: DataFrame, path: str) -> None:
    """Keep flows (sym, date YYYYMMDD, figures) by year, sorted by date and symbol, so that days, spans and symbols are read pruned."""
    made = rows.withColumn("year", F.floor(F.col("date") / 10_000).cast("int"))
    made.repartitionByRange("year", "date").sortWithinPartitions("date", SYM).write.mode("overwrite").partitionBy("year").parquet(path)


def read_flows(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None, symbols: list[str] | None = None,
) -> DataFrame:
    """Flows of a span of dates and of some symbols; years outside are not listed, row groups outside are skipped."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where((F.col("year") >= first // 10_000) & (F.col("date") >= first))
    if last is not None:
        rows = rows.where((F.col("year") <= last // 10_000) & (F.col("date") <= last))
    return (rows.where(F.col(SYM).isin(symbols)) if symbols is not None else rows).drop("year")


def first_per_date(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first by ``order``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("__v")).select(*keys, "__v.*")


def style_leaves(panel: DataFrame, styles: DataFrame, order: str = "seq") -> DataFrame:
    """``panel`` with the style columns that ``styles`` (sym, date, styles, order) has, the first row of a date counting; other styles are NULL."""
    have = [c for c in STYLES if c in styles.columns]
    rows = first_per_date(styles.select(SYM, "date", order, *have), [SYM, "date"], order).drop(order)
    return panel.join(rows, [SYM, "date"], "left").withColumns({c: F.lit(None).cast("double") for c in STYLES if c not in have})


def complete(panel: DataFrame) -> DataFrame:
    """``panel`` with every leaf that expressions may name; those of stores that are not there are NULL."""
    return panel.withColumns({c: F.lit(None).cast("double") for c in LEAVES if c not in panel.columns})


def industry_code(members: list[str]) -> Column:
    """The position of the largest of the membership columns if it is above one half, else -1."""
    held = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in members])
    return F.when(F.array_max(held) > 0.5, F.array_position(held, F.array_max(held)) - 1).otherwise(-1).cast("int")


def _over(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a, b))


def _ratios(c: dict[str, Column], old: dict[str, Column]) -> dict[str, Column]:
    grown = lambda k: _over(c[k], old[k]) - 1
    return {
        "fa_np_yoy": grown("np"), "fa_rev_yoy": grown("rev"), "fa_op_yoy": grown("op"), "fa_ocf_yoy": grown("ocf"), "fa_gm": _over(c["gp"], c["rev"]), "fa_np_margin": _over(c["np"], c["rev"]),
        "fa_roe": _over(c["np"], c["equity"]), "fa_lev": _over(c["liabilities"], c["assets"]), "fa_accrual": _over(c["ocf"], c["np"]), "fa_asset_turn": _over(c["rev"], c["assets"]),
        "fa_gw": _over(c["goodwill"], c["assets"]), "fa_inv_turn": _over(c["rev"], c["inventory"]), "fa_recv_turn": _over(c["rev"], c["receivable"]), "fa_sell_exp": _over(c["sell_exp"], c["rev"]),
        "fa_ocf_ta": _over(c["ocf"], c["assets"]),
    }


def financial_leaves(reports: DataFrame, panel: DataFrame) -> DataFrame:
    """``panel`` (sym, date, mktcap ...) with the 17 financial leaves as known on each date.

    ``reports`` are (sym, quarter = 4 * year + quarter - 1, info_date, the figures of ``REPORT``).  Each announcement is an event, at
    which the largest quarter known so far is looked up with the figures last announced for it, for the quarter a year before and
    for the last year-end; the ratios hold from the next date to the next event.  Book and free cash flow are taken over each
    date's market value.
    """
    figures = F.struct(*REPORT)
    rows = reports.groupBy(SYM, "quarter", "info_date").agg(F.max(figures).alias("v"))  # one report per day and quarter
    known = F.max("quarter").over(Window.partitionBy(SYM).orderBy("info_date").rangeBetween(Window.unboundedPreceding, 0))
    events = rows.select(SYM, "info_date", known.alias("q")).distinct()
    keyed = rows.select(F.struct(SYM, F.col("quarter").alias("q")).alias("k"), F.col("info_date").alias("at"), "v")
    frame = events.withColumn("at", F.col("info_date"))
    q = F.col("q")
    for name, quarter in (("now", q), ("old", q - 4), ("end", q - q % 4 - 1)):
        frame = frame.withColumn("k", F.struct(SYM, quarter.alias("q")))
        frame = as_of(frame, keyed.withColumnRenamed("v", name), "k", "at", [name])
    c, old = ({k: F.col(f"{side}.{k}") for k in REPORT} for side in ("now", "old"))
    spent = c["capex_ytd"] + F.col("end.capex_ytd") - old["capex_ytd"]
    made = _ratios(c, old) | {"__book": c["equity"], "__free": c["ocf"] - spent}
    events = frame.select(SYM, F.col("info_date").alias("date"), *[v.alias(k) for k, v in made.items()])
    out = as_of(panel, events, SYM, "date", list(made), strict=True)
    return out.withColumns(
        {"fa_pb": _over(F.col("__book"), F.col("mktcap")), "fa_fcf_yield": _over(F.col("__free"), F.col("mktcap"))}
    ).drop("__book", "__free")


def alternative_leaves(panel: DataFrame, margin: DataFrame, boards: DataFrame, seats: DataFrame, blocks: DataFrame) -> DataFrame:
    """``panel`` (sym, date, mktcap, turnover ...) with five ratios of disclosures; NULL where a symbol has none on a date.

    ``margin`` (sym, date, balance, bought), ``boards`` (sym, date, seq, net, buy, sell: the last row counts, ``net`` or buy - sell), ``seats``
    (sym, date, buy, sell) and ``blocks`` (sym, date, amount) are summed per symbol and date.
    """
    keys = [SYM, "date"]
    nil = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = [
        margin.groupBy(*keys).agg(F.sum(nil("balance")).alias("__bal"), F.sum(nil("bought")).alias("__buy")),
        boards.groupBy(*keys).agg(F.max_by(F.coalesce("net", nil("buy") - nil("sell")), F.col("seq")).alias("__net")),
        seats.groupBy(*keys).agg(F.sum(nil("buy") - nil("sell")).alias("__seat")),
        blocks.groupBy(*keys).agg(F.sum(nil("amount")).alias("__block")),
    ]
    frame = reduce(lambda f, p: f.join(p, keys, "left"), parts, panel)
    share = lambda x, of: F.when(F.col(of) > 0, _over(F.col(x), F.col(of)))
    made = {
        "mg_bal_ratio": share("__bal", "mktcap"), "mg_buy_ratio": share("__buy", "turnover"), "lhb_net_ratio": share("__net", "turnover"),
        "lhb_inst_ratio": share("__seat", "turnover"), "block_vol_ratio": share("__block", "turnover"),
    }
    return frame.withColumns(made).drop("__bal", "__buy", "__net", "__seat", "__block")


def index_closes(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(index_id, date, close) with one row per index and date, the first one, and no missing close."""
    held = rows.where(F.col("close").isNotNull())
    return first_per_date(held.select("index_id", "date", order, "close"), ["index_id", "date"], order).drop(order)

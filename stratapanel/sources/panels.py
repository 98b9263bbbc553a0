"""Dense panels (sym, t, ...) over calendar x symbols.  A cell without data is a row of NULLs, so that row frames are calendar
frames.  The grid comes from exploding each symbol's range of dates; no cross join is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import safe_div, safe_log
from ..functions.ts import SYM, T, line

#: Leaves that come straight from prices, volumes and market values.
BASE = ("close", "open", "high", "low", "volume", "turnover", "mktcap")
DERIVED = (
    "vwap", "ret", "turn_ratio", "ln_mktcap", "ln_volume", "overnight", "intraday", "amplitude", "up_shadow", "down_shadow", "hl_ratio",
    "true_range",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densify(cells: DataFrame, symbols: DataFrame, first: int, last: int) -> DataFrame:
    """``cells`` (sym, t, values) on the grid of ``symbols`` x first..last, partitioned by symbol for the operators along time."""
    grid = symbols.select(SYM, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(T))
    return grid.join(cells, [SYM, T], "left")


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of shipment x suppliers: unit prices, quantities and amounts; market value is the trailing 12-row turnover.

    Further columns: ``date`` (YYYYMM), ``industry`` (the supplier's nation) and ``pool`` (its region).
    """
    items = read(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = items.select(
        F.col("l_suppkey").alias(SYM), month.alias("m"), price.alias("p"), "l_quantity", "l_extendedprice",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"),
    )
    first, last = rows.agg(F.min("m"), F.max("m")).head()
    cells = rows.groupBy(SYM, (F.col("m") - first).alias(T)).agg(
        F.try_divide(
            F.sum("l_extendedprice"), F.sum("l_quantity"),
        ).alias("close"), F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
    )
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("pool"))
    symbols = read(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select(
        F.col("s_suppkey").alias(SYM), F.col("s_nationkey").alias("industry"), "pool",
    )
    grid = symbols.select(SYM, "industry", "pool", F.explode(F.sequence(F.lit(0), F.lit(last - first))).alias(T))
    months = F.col(T) + first
    panel = grid.join(cells, [SYM, T], "left").withColumn("date", (F.floor(months / 12) * 100 + months % 12 + 1).cast("int"))
    return panel.withColumn("mktcap", F.sum("turnover").over(line().rowsBetween(-11, 0)))


def shipping_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of shipment x the suppliers' nations: unit prices, quantities and amounts.  Some 2,500 days, for windows that the months are too few for."""
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias(SYM))
    items = read(spark, sf_dir, "lineitem").join(nation, "l_suppkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = items.select(
        SYM, F.to_date("l_shipdate").alias("d"), price.alias("p"), "l_quantity", "l_extendedprice",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"),
    )
    first, last = rows.agg(F.min("d"), F.max("d")).head()
    cells = rows.groupBy(SYM, F.datediff("d", F.lit(first)).alias(T)).agg(
        F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), F.min_by("p", "at").alias("open"), F.max("p").alias("high"),
        F.min("p").alias("low"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
    )
    panel = densify(cells, rows.select(SYM).distinct(), 0, (last - first).days)
    return panel.withColumn("mktcap", F.sum("turnover").over(line().rowsBetween(-11, 0)))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days x users: open, high, low and close of the event values, their number and sum.  ``date`` is YYYYMMDD."""
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias(SYM), F.to_date("ts").alias("d"), "value", F.struct("ts", "event_id").alias("at"),
    )
    first, last = rows.agg(F.min("d"), F.max("d")).head()
    cells = rows.groupBy(SYM, F.datediff("d", F.lit(first)).alias(T)).agg(
        F.max_by("value", "at").alias("close"), F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.count("*").cast("double").alias("volume"), F.sum("value").alias("turnover"),
    )
    panel = densify(cells, rows.select(SYM).distinct(), 0, (last - first).days)
    day = F.date_add(F.lit(first), F.col(T))
    return panel.withColumn("date", F.date_format(day, "yyyyMMdd").cast("int")).withColumn(
        "mktcap", F.sum("turnover").over(line().rowsBetween(-11, 0)),
    )


def derived_leaves(divide: Callable[[Column, Column], Column] = F.try_divide) -> dict[str, Column]:
    """Leaves from prices; over a price of zero there is none, or with ``divide=ieee_div`` an infinite one."""
    c = F.col
    pc = F.lag("close").over(line())
    rng = c("high") - c("low")
    top, bottom = F.when(
        c("open").isNotNull() & c("close").isNotNull(), F.greatest("open", "close"),
    ), F.when(c("open").isNotNull() & c("close").isNotNull(), F.least("open", "close"))
    return {
        "vwap": c("turnover") / F.when(c("volume").isNotNull(), F.greatest(c("volume"), F.lit(1e-9))),
        "ret": divide(c("close"), pc) - 1,
        "turn_ratio": c("turnover") / F.when(c("mktcap").isNotNull(), F.greatest(c("mktcap"), F.lit(1e-9))),
        "ln_mktcap": safe_log(c("mktcap")),
        "ln_volume": safe_log(c("volume")),
        "overnight": divide(c("open"), pc) - 1,
        "intraday": divide(c("close"), c("open")) - 1,
        "amplitude": divide(rng, pc),
        "up_shadow": safe_div(c("high") - top, rng),
        "down_shadow": safe_div(bottom - c("low"), rng),
        "hl_ratio": divide(c("high"), c("low")),
        "true_range": divide(F.when(pc.isNotNull(), F.greatest(rng, F.abs(c("high") - pc), F.abs(c("low") - pc))), pc),
    }


def with_leaves(panel: DataFrame, divide: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    return panel.withColumns(derived_leaves(divide))


def forward_return(f: int, divide: Callable[[Column, Column], Column] = F.try_divide) -> Column:
    """Return of buying at the next close and holding f rows."""
    return divide(F.lead("close", 1 + f).over(line()), F.lead("close", 1).over(line())) - 1

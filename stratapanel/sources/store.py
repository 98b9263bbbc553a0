"""Panel files: a factor store, quantised copies, schema-safe appends, upserts, and ingestion of raw CSV files."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cs
from ..functions.scalar import date_key, exchange_code
from ..functions.ts import SYM, T
from ..operators.combination import as_of
from .versions import Log


_FACTOR = "factor_id string, rows long, present long, first long, last long, meta string"


def factor_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, _FACTOR)


def write_factor(values: DataFrame, path: str, factor_id: str, **meta: object) -> None:
    """Write (sym, t, value) of one factor, sorted by date, in place of what the store has of it; ``meta`` is kept with it.

    The values are written aside and count from the moment their entry is logged; readers that are open keep the version they have.
    """
    spark, log = values.sparkSession, factor_log(values.sparkSession, path)
    folder = f"data/version={uuid.uuid4().hex}/factor_id={factor_id}"
    values.select(SYM, T, "value").repartitionByRange(T).sortWithinPartitions(T, SYM).write.parquet(f"{path}/{folder}")
    told = spark.read.parquet(f"{path}/{folder}").agg(
        F.count("*"), F.count("value"), F.min(T).cast("long"), F.max(T).cast("long"),
    ).head()
    old = [("drop", r["folder"], None, None, None, None, None, None) for r in log.held() if r["factor_id"] == factor_id]
    log.add([("add", folder, factor_id, *told, json.dumps(meta, sort_keys=True)), *old])


def open_factors(spark: SparkSession, path: str) -> DataFrame:
    """All factors as they are now; filters on ``factor_id`` prune folders, filters on ``t`` skip row groups."""
    folders = [f"{path}/{r['folder']}" for r in factor_log(spark, path).held()]
    if not folders:
        raise FileNotFoundError(f"{path} holds no factors")
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("version")


def read_factor(
    spark: SparkSession, path: str, factor_id: str, first: int | None = None, last: int | None = None, symbols: list | None = None,
    on: list[int] | None = None,
) -> DataFrame:
    """(sym, t, value) of one factor: a day, a window, some symbols, or given dates; all of these are pushed to the scan."""
    rows = open_factors(spark, path).where(F.col("factor_id") == factor_id)
    if first is not None:
        rows = rows.where(F.col(T) >= first)
    if last is not None:
        rows = rows.where(F.col(T) <= last)
    if symbols is not None:
        rows = rows.where(F.col(SYM).isin(symbols))
    return (rows.where(F.col(T).isin(on)) if on is not None else rows).select(SYM, T, "value")


def recent(rows: DataFrame, n: int = 600, least: int = 300) -> DataFrame:
    """The last ``n`` dates, or all where there are fewer than ``least`` among these."""
    days = rows.select(T).distinct()
    span = days.agg(F.max(T).alias("last"), F.count("*").alias("days"))
    from_ = F.when(F.least("days", F.lit(n)) >= least, F.col("last") - n)
    span = span.select(from_.alias("__from"))
    return rows.crossJoin(span).where(F.col("__from").isNull() | (F.col(T) > F.col("__from"))).drop("__from")


def latest_at(rows: DataFrame, keys: list[str], when: str, at: int) -> DataFrame:
    """The last ``when`` of each key at or before ``at``."""
    return rows.where(F.col(when) <= at).groupBy(*keys).agg(F.max(when).alias(when))


def joined_results(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Result tables by keys that may be of other types on either side: they are compared as trimmed text."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    named = right.select(*[text(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    met = [text(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, met, how).drop(*[f"__{k}" for k in keys])


def with_fallback(own: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both tables; figures are the own ones where present, else the other's."""
    values = [c for c in own.columns if c not in keys]
    right = other.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    return own.join(right, keys, "full").select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in values])


def write_entries(rows: DataFrame, path: str) -> None:
    """Append rows as lines of JSON."""
    rows.write.mode("append").json(path)


def list_factors(spark: SparkSession, path: str) -> DataFrame:
    """A row per factor, from the log alone: rows, values present, first and last date, meta."""
    held = [tuple(r[c] for c in ("factor_id", "rows", "present", "first", "last", "meta")) for r in factor_log(spark, path).held()]
    return spark.createDataFrame(held, _FACTOR)


def quantised(values: DataFrame, levels: int = 256) -> DataFrame:
    """Each value as its quantile code 0 .. levels - 1 within the date; NULL where missing or alone."""
    n = cs.count_of(F.col("value"))
    code = F.least(F.floor((cs.place(F.col("value")) - 1) * levels / n), F.lit(levels - 1))
    return values.select(SYM, T, F.when(F.col("value").isNotNull() & (n >= 2), code).cast("short").alias("code"))


def append(rows: DataFrame, path: str) -> None:
    """Append, whatever columns are new or missing; read with :func:`read_merged`."""
    rows.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not in ``new``, and all new rows; columns are aligned by name."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a partial aggregation instead of a sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def read_money_flow(
    spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", sep: str = ",", code: str = "code", date: str = "date",
) -> DataFrame:
    """A CSV with any figures beside a code and a date column: codes get their exchange, dates become keys, figures doubles.

    Rows without a valid code or date are left out; of repeated rows of a (date, code) the last by file order does not matter, so
    the largest is taken.
    """
    raw = spark.read.option("header", "true").option("encoding", encoding).option("sep", sep).csv(path)
    figures = [c for c in raw.columns if c not in (code, date)]
    rows = raw.select(
        exchange_code(F.col(code)).alias(SYM), date_key(F.col(date)).alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in figures],
    )
    rows = rows.where(F.col(SYM).isNotNull() & F.col("date").isNotNull())
    return rows.groupBy(SYM, "date").agg(*[F.max(c).alias(c) for c in figures])


#: Separators that are told apart.
SEPARATORS = (",", "\t", ";", "|")


def _sniffed(spark: SparkSession, path: str) -> DataFrame:
    """``path, encoding, sep, lines`` of each file: UTF-8 unless its bytes aren't, else GBK; the separator of which all first lines have most.  Files
    are read as one row each, so this is for many small ones; :func:`read_money_flow` reads large ones by splits."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.col("content").cast("string")
    plain = F.is_valid_utf8(text)

    @F.pandas_udf("string")
    def from_gbk(content: pd.Series) -> pd.Series:
        return content.map(lambda x: None if x is None else bytes(x).decode("gbk", "replace"))

    files = files.select(
        "path", F.when(plain, "UTF-8").otherwise("GBK").alias("encoding"), F.coalesce(F.when(plain, text), from_gbk(F.when(~plain, F.col("content")))).alias("text"),
    )
    files = files.withColumn("lines", F.filter(F.split("text", "\r?\n"), lambda x: x != ""))
    first = F.slice("lines", 1, 5)
    least = lambda s: F.array_min(F.transform(first, lambda x: F.length(x) - F.length(F.replace(x, F.lit(s), F.lit("")))))
    kinds = F.array(*[F.struct(least(s).alias("n"), F.lit(-i).alias("o"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)])
    return files.select("path", "encoding", F.array_max(kinds)["sep"].alias("sep"), "lines")


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and separator of the first file by name."""
    r = _sniffed(spark, path).orderBy("path").select("encoding", "sep").head()
    return r["encoding"], r["sep"]


def read_money_flows(spark: SparkSession, path: str, code: str = "code", date: str = "date") -> DataFrame:
    """:func:`read_money_flow` for many small files of different encodings, separators and columns: two jobs, one for the columns' names and one for
    the rows.  Files that lack a column have NULL there; of a repeated (symbol, date) the largest figures are taken."""
    files = _sniffed(spark, path).where(F.size("lines") > 0)
    names = F.split(F.element_at("lines", 1), F.concat(F.lit("\\Q"), "sep", F.lit("\\E")), -1)
    heads = files.withColumn("names", F.transform(names, lambda x: F.trim(F.replace(F.trim(x), F.lit('"'), F.lit("")))))
    found = heads.select(F.explode("names").alias("name"), F.size("names").alias("width")).groupBy("name").agg(F.max("width").alias("width")).collect()
    figures = sorted(r["name"] for r in found if r["name"] not in (code, date, ""))
    most = max([r["width"] for r in found], default=1)
    ddl = ", ".join(f"c{i} string" for i in range(most))
    row = F.coalesce(*[F.when(F.col("sep") == s, F.from_csv("line", ddl, {"sep": s})) for s in SEPARATORS])
    rows = heads.select("sep", "names", F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    rows = rows.withColumn("row", row).withColumn("cells", F.array(*[F.col(f"row.c{i}") for i in range(most)])).withColumn("held", F.map_from_arrays("names", F.slice("cells", F.lit(1), F.size("names"))))
    at = lambda c: F.try_element_at("held", F.lit(c))
    rows = rows.select(
        exchange_code(at(code)).alias(SYM), date_key(at(date)).alias("date"), *[at(c).try_cast("double").alias(c) for c in figures],
    )
    return latest_of_files(rows.where(F.col(SYM).isNotNull() & F.col("date").isNotNull()))


def latest_of_files(rows: DataFrame) -> DataFrame:
    """One row per symbol and date, the largest figures where files repeat one."""
    figures = [c for c in rows.columns if c not in (SYM, "date")]
    return rows.groupBy(SYM, "date").agg(*[F.max(c).alias(c) for c in figures])


def fingerprint(spark: SparkSession, paths: list[str], *code: Callable) -> str:
    """A digest of the files below ``paths`` (names, sizes, times of change) and of the source of the functions that make a panel of them."""
    seen = [spark.read.format("binaryFile").load(p).select("path", "length", "modificationTime") for p in paths]
    rows = seen[0]
    for s in seen[1:]:
        rows = rows.unionByName(s)
    of = lambda salt: F.sum(F.xxhash64("path", "length", F.unix_micros("modificationTime"), F.lit(salt)).cast("decimal(38,0)"))
    mark = rows.agg(F.count("*"), of(1), of(2)).head()
    return hashlib.sha256("\n".join([*map(str, mark), *(inspect.getsource(f) for f in code)]).encode()).hexdigest()


def money_flow_leaves(flow: DataFrame, panel: DataFrame, amounts: list[str], lots: list[str]) -> DataFrame:
    """Figures in base units (amounts x 10,000, lots x 100), 0 where the symbol traded but has no record."""
    scaled = flow.select(SYM, "date", *[(F.col(c) * 1e4).alias(c) for c in amounts], *[(F.col(c) * 100).alias(c) for c in lots])
    joined = panel.join(scaled, [SYM, "date"], "left")
    return joined.withColumns({c: F.when(F.col("close").isNotNull(), F.coalesce(c, F.lit(0.0))) for c in [*amounts, *lots]})


def point_in_time(reports: DataFrame, dates: DataFrame, items: list[str]) -> DataFrame:
    """What was known on each date: the figures of the largest quarter reported before it, as last revised before it.

    ``reports`` are (sym, quarter, info_date, items); ``dates`` (sym, date).  Reports become events with the running largest
    quarter and the running trailing-year figures of that quarter, and one running ``last`` carries them to the dates.
    """
    over = Window.partitionBy(SYM).orderBy("info_date", "quarter").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct("quarter", "info_date", *items)).over(over)
    events = reports.withColumn("top", top).groupBy(SYM, "info_date").agg(F.max("top").alias("top"))
    flat = events.select(
        SYM, F.col("info_date").alias("date"), F.col("top.quarter").alias("known_quarter"), *[F.col(f"top.{c}").alias(c) for c in items],
    )
    return as_of(dates, flat, SYM, "date", ["known_quarter", *items], strict=True)


def trailing_year(reports: DataFrame, item: str) -> DataFrame:
    """YTD(q) + annual(previous year) - YTD(q - 4); NULL where a part is missing.  ``quarter`` is 4 * year + quarter - 1."""
    q = F.col("quarter")
    own = reports.select(SYM, "quarter", F.col(item).alias("ytd"))
    back = own.select(SYM, (q + 4).alias("quarter"), F.col("ytd").alias("ytd_back"))
    annual = own.where(q % 4 == 3).select(SYM, q.alias("year_end"), F.col("ytd").alias("annual"))
    joined = own.withColumn("year_end", q - q % 4 - 1).join(back, [SYM, "quarter"], "left").join(annual, [SYM, "year_end"], "left")
    return joined.select(SYM, "quarter", (F.col("ytd") + F.col("annual") - F.col("ytd_back")).alias("ttm"))


class StalePanel(RuntimeError):
    """A kept panel does not come from the inputs or the code it is asked for."""


def keep_panel(panel: DataFrame, path: str, fingerprint: str) -> None:
    """Write a panel partitioned by date range and sorted by symbol, with a manifest of where it comes from."""
    panel.repartitionByRange(T).sortWithinPartitions(T, SYM).write.mode("overwrite").parquet(f"{path}/panel")
    rows = panel.sparkSession.range(1).select(F.lit(fingerprint).alias("fingerprint"), F.lit(",".join(panel.columns)).alias("columns"))
    rows.write.mode("overwrite").parquet(f"{path}/manifest")


def open_panel(spark: SparkSession, path: str, fingerprint: str, columns: list[str] | None = None) -> DataFrame:
    """A kept panel, pruned to ``columns``; fails loudly where the fingerprint or a column doesn't match."""
    found = spark.read.parquet(f"{path}/manifest").head()
    if found["fingerprint"] != fingerprint:
        raise StalePanel(f"{path} was made from {found['fingerprint']}")
    missing = set(columns or []) - set(found["columns"].split(","))
    if missing:
        raise StalePanel(f"{path} lacks {sorted(missing)}")
    panel = spark.read.parquet(f"{path}/panel")
    return panel.select(SYM, T, *columns) if columns else panel

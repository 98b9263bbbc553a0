"""Mixing sources to target weights.

Every source gets a repetition rate = target / size.  A document is emitted floor(rate) times, plus one more copy with a
probability equal to the fraction of the rate, decided by a hash of its id.  The hash gives a 32-bit uniform u; adding
j / SHIFTS to u (modulo 1) gives another uniform, so any j is a valid seed.  Each source takes the j whose copies come
nearest to its target, which is found in the same aggregation for all j at once.

Cases: null texts count as empty and have size 0; null sources are one source, ordered last; an empty table gives an empty
result; repeated rows are decided alike; a source of size 0 has rate 0 and emits nothing; other columns pass through
:func:`mix` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, materialise, packed

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Seeds tried per source.
SHIFTS = 128
_SPAN = 1 << 32


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(ident: str) -> Column:
    """The first 32 bits of the MD5 of the id, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(ident).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Targets per source: ``__source, __docs, __source_size, __target`` from rows ``__source, __size``.

    Sources in order of code point (null last) get ``weights`` in turn; a target stops at ``most`` times its source's size and
    the excess is shared again by weight.  That is a water level: with sources sorted by cap / weight, those below the level
    are full.  The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("__source").agg(F.count("*").alias("__docs"), F.sum("__size").alias("__source_size"))
    whole = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("__w", weight.cast("double")).withColumn("__cap", F.col("__source_size") * F.lit(float(most)))
    per = per.withColumn("__total", F.sum("__source_size").over(whole).cast("double"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    per = per.withColumn("__level", level)
    open_ = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))
    per = per.withColumn("__level", F.coalesce(F.max(open_).over(whole), F.lit(0.0)))
    return per.select("__source", "__docs", "__source_size", F.least(F.col("__level") * F.col("__w"), F.col("__cap")).alias("__target"))


def _rated(per: DataFrame, most: float) -> DataFrame:
    rate = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(float(most)))).otherwise(0.0)
    per = per.withColumn("__rate", rate).withColumn("__whole", F.floor("__rate").cast("long"))
    return per.withColumn("__cut", F.floor((F.col("__rate") - F.col("__whole")) * _SPAN).cast("long"))


def _one_more(shift: Column | int) -> Column:
    return ((F.col("__u") + shift * (_SPAN // SHIFTS)) % _SPAN < F.col("__cut")).cast("long")


def _key(source: str) -> Column:
    """A source as a key that is never null."""
    return F.concat(F.when(F.col(source).isNull(), "-").otherwise("+"), F.coalesce(F.col(source).cast("string"), F.lit("")))


def plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """A table with one row per source: its key and documents, size, target, whole copies, cut of the hash, and the chosen shift."""
    per = materialise(_rated(targets(sizes, weights, most), most).withColumn("__key", _key("__source")).drop("__source"), "mix-targets")
    joined = attach_groups(sizes.select(_key("__source").alias("__key"), "__size", "__u"), per, "__key", "__docs")
    keys = ["__key", "__docs", "__source_size", "__target", "__whole", "__cut"]
    sums = joined.groupBy(*keys).agg(*[F.sum(F.col("__size") * (F.col("__whole") + _one_more(j))).alias(f"__t{j}") for j in range(SHIFTS)])
    off = F.array(
        *[F.struct(F.abs(F.col(f"__t{j}") - F.col("__target")).alias("off"), F.lit(j).cast("long").alias("shift")) for j in range(SHIFTS)]
    )
    return materialise(sums.select(*keys, F.array_min(off)["shift"].alias("__shift")), "mix-plan")


def sized(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(ident).alias("__id"), F.col(source).alias("__source"), word_count(text).alias("__size"), unit_hash(ident).alias("__u"),
    )


def mixture(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3.0,
) -> DataFrame:
    """One row per document with its size, its source's size and target, the copies the mix takes and their words."""
    sizes = materialise(sized(docs, ident, text, source), "mix-sizes")
    return _decided(sizes, plan(sizes, weights, most)).select(
        F.col("__id").alias(ident), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"),
    )


def _decided(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` with what is decided for their source; sources with many documents are looked up where the rows are read, the others joined."""
    found = attach_groups(rows.withColumn("__key", _key("__source")), per, "__key", "__docs")
    return found.withColumn("__copies", F.col("__whole") + _one_more(F.col("__shift")))


def mix(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3.0,
) -> DataFrame:
    """The mix itself: every row of ``docs``, with its own columns, as often as the mix takes it."""
    sizes = materialise(sized(docs, ident, text, source), "mix-sizes")
    rows = packed(docs, __source=F.col(source), __u=unit_hash(ident))
    rows = _decided(rows, plan(sizes, weights, most)).where("__copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")

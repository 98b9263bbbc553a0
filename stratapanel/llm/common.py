"""Helpers shared by the training-data operators: shared tables, skew-safe lookups, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent (tests on a local master) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone when Python exits
        pass


def _clean_up() -> None:
    for path, spark in _WRITTEN.items():
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _remove(spark, path)


atexit.register(_clean_up)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python exits."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at files that survive lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table made by :func:`materialise` that nothing will read again."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        for known in [p for p in _WRITTEN if path.rstrip("/").endswith(p.split(":", 1)[-1].lstrip("/"))]:
            _remove(_WRITTEN.pop(known), known)


#: A group with at least 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot groups whatever the input.
HOT_SHARE = 1000


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner-join ``rows`` to ``groups`` (one row per key; ``size`` is the number of rows of that key) without skew.

    Hot keys, of which there are at most ``HOT_SHARE`` by their definition, are looked up in a broadcast table; all other
    keys hold few rows each and join by a shuffle (or as Spark sees fit).  Both inputs are read twice, so pass tables.
    """
    total = groups.agg(F.sum(size)).head()[0] or 0
    is_hot = F.col(size) * HOT_SHARE >= total
    hot = F.broadcast(groups.where(is_hot))
    cold = groups.where(~is_hot)
    few = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(few.join(cold, key))


#: Bits of a key filter per key, and its largest size; beyond that it lets more rows through, but never holds back one of the keys.
BITS_PER_KEY = 16
FILTER_BITS = 1 << 28


def _marked(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``rows`` with their piece of a bitmap of ``keys``, where there is one, and whether their bit is set in it."""
    bits = 1 << 15
    while bits < min(FILTER_BITS, BITS_PER_KEY * keys.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(bits))
    piece, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    pieces = keys.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("map"))
    byte = F.conv(F.hex(F.substring("map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return rows.withColumn("piece", piece).join(F.broadcast(pieces), "piece", "left"), F.coalesce(is_set, F.lit(False))


def likely_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``keys`` (a written table, one row per key), and few others, without a shuffle; an exact join is to follow.

    The keys set bits of a bitmap of at most ``FILTER_BITS`` bits (32 MB), in pieces of 4 KB; rows whose bit is not set are
    held back where they are read, so that about one foreign row in ``BITS_PER_KEY`` passes.
    """
    marked, is_set = _marked(rows, keys, key)
    return marked.where(is_set).select(*rows.columns)


def surely_not_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that :func:`likely_among` holds back."""
    marked, is_set = _marked(rows, keys, key)
    return marked.where(~is_set).select(*rows.columns)


def hash_share(share: float | Column, *cols: str | Column) -> Column:
    """Whether the hash of ``cols`` falls into the first ``share`` of its range, cut in steps of 1 / 2**52: rows that are sampled."""
    unit = F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") / float(1 << 52)
    return unit < share


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows are read, and go to Python, in batches of at most ``rows``, unless the session says otherwise: memory holds few whole texts."""
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", 512)):
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, str(most))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row as the struct ``row`` beside the columns ``more``, so that names in ``df`` can't clash; undone by ``select("row.*")``."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in more.items()])


def surviving(docs: DataFrame, ident: str, text: str, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay.  ``decided`` has a row ``id, sha, kept, copies`` per row of ``docs``: its id, the SHA-256 of its text,
    whether it stays, and the number of rows with its text.  Of rows that are equal in id and text one stays."""
    decided = materialise(decided, "decided")
    lost = decided.where("not kept").select(F.col("id").alias("lost"), F.col("sha").alias("lost_sha")).distinct()
    again = decided.where("kept and copies > 1").groupBy(
        F.col("id").alias("lost"), F.col("sha").alias("lost_sha"),
    ).agg(F.count("*").alias("n")).where("n > 1")
    pair = lambda i, h: F.xxhash64(F.col(i).isNull(), i, h)
    rows = packed(docs, id=F.col(ident), sha=F.sha2(text_of(text), 256)).withColumn("key", pair("id", "sha"))
    keys = materialise(lost.select("lost", "lost_sha").unionByName(again.select("lost", "lost_sha")).select(pair("lost", "lost_sha").alias("key")).distinct(), "decided-keys")
    # rows that nothing is decided about pass where they are read; only the others meet the decisions
    sure, rows = surely_not_among(rows, keys, "key").select("row.*"), likely_among(rows, keys, "key")
    same = F.col("id").eqNullSafe(F.col("lost")) & (F.col("sha") == F.col("lost_sha"))
    rows = rows.join(lost, same, "left_anti")
    if not again.head(1):
        return sure.unionByName(rows.select("row.*"))
    one = rows.join(again, same, "left_semi").groupBy("id", "sha").agg(F.any_value("row").alias("row"))
    return sure.unionByName(rows.join(again, same, "left_anti").select("row.*")).unionByName(one.select("row.*"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Label every node of ``edges`` with the smallest node it reaches: columns ``node`` and ``component``.

    Alternates the large-star and small-star steps until nothing changes; both group by node with a partial minimum, and each
    round is a table in the shared folder.  Nodes without an edge don't appear.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = materialise(edges.where(F.col(a) != F.col(b)).select(big, small).distinct(), "cc")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        after = star.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(after.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        drop_table(links)
        links = after
        if mark == seen:
            break
        seen = mark
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))

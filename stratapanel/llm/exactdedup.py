"""Exact de-duplication with an extendible-hash index on shared files (DataFrame operations only).

1. Each row becomes a slim row (id, 64-bit hash of the text, SHA-256) in a table of the shared folder, and rows fold to one
   entry per hash (partial aggregation collapses copies in the map tasks).
2. The directory maps the leading bits of a hash to a bucket.  While a slot of it holds more entries than the capacity, the
   directory doubles; a bucket takes as few bits as it can, so that several slots may lead to one bucket.  The capacity grows
   with the input so that the directory stays at some 100,000 slots, a few MB, and every task can hold it.
3. Entries are dealt to owner tasks by ranges of buckets, so that a file of the index holds a range of hashes in order.
4. Entries of more than one row are chained: their texts are compared byte by byte, by grouping on (hash, text), again with
   partial aggregation, so a group of any number of copies is one row per map task.  Different texts with one hash become
   links of one chain.  Only texts of such entries move: others are held back by a filter on the hash where they are read.
5. A row goes by its slot to the bucket, and there to the link of the chain that has its hash and its digest.  Hot groups are
   looked up in a bounded broadcast.

Cases: null texts count as empty; null ids are grouped but never stay where another id is present; repeated rows (same id, same
text) are one document, and all of them are marked as kept in :func:`exact_groups`, while :func:`deduplicate` returns one of them;
different texts with one id, or with none, are different documents; very long texts are hashed and compared whole; an empty table
gives an empty result; other columns, whatever their names, pass through :func:`deduplicate` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, likely_among, materialise, surviving, text_of

#: Entries that a bucket may hold, at least; with more than DIRECTORY times as many entries the capacity grows.
CAPACITY = 4096
DIRECTORY = 1 << 14
#: Leading bits the directory may use.  Only hashes that are not spread evenly could need more; their bucket is a longer run of its file.
MAX_DEPTH = 20
#: Entries that an owner's file holds, about.
PER_OWNER = 1 << 20


def _hash(body: Column, bits: int) -> Column:
    """The hash of a text; fewer than 64 ``bits`` keep the leading ones only, so that different texts collide (for tests)."""
    return F.xxhash64(body) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 64 - bits), 64 - bits)


def _slot(hash_: Column, depth: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Slots of the directory, ``slot, depth, bucket``, and the global depth; ``bucket`` is the first slot that leads to it.

    ``entries`` has one row per hash, column ``h``.  The directory is doubled until no slot holds more than ``capacity`` entries.
    """
    n = entries.count()
    capacity = max(capacity, n // DIRECTORY)
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)))
    while True:
        slots = materialise(entries.groupBy(_slot(F.col("h"), depth).alias("slot")).agg(F.count("*").alias("held")), "hash-slots")
        if depth >= MAX_DEPTH or not slots.where(F.col("held") > capacity).head(1):
            break
        depth += 1
    # buddies that fit into one bucket together share it: the fewest bits whose bucket fits
    levels = slots.select("slot", "held", F.explode(F.sequence(F.lit(max(0, depth - 6)), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)"))
    fits = F.sum("held").over(Window.partitionBy("depth", "bucket")) <= capacity
    levels = levels.withColumn("fits", fits | (F.col("depth") == depth)).where("fits")
    best = levels.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("at"))
    return materialise(best.select("slot", F.col("at.depth").alias("depth"), F.col("at.bucket").alias("bucket")), "hash-directory"), depth


def _placed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory leads to.  The directory has at most 2**MAX_DEPTH slots, and about 8 * DIRECTORY by its capacity."""
    return rows.withColumn("slot", _slot(F.col("h"), depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")


def build_index(rows: DataFrame, texts: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index over rows ``id, h, sha`` and texts ``id, h, body``: its chains, its directory, and the directory's depth.

    A link of a chain is ``bucket, h, link, sha, n, keep``; links are written owner by owner, in order of bucket and hash.
    """
    entries = materialise(
        rows.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keep"), F.max("sha").alias("sha")), "hash-entries",
    )
    slots, depth = directory(entries.select("h"), capacity)
    repeated = entries.where("n > 1").select("h")
    # copies fold in the map tasks, before the join, so that no group of copies meets in one task
    compared = likely_among(texts, repeated, "h").groupBy("h", "body").agg(
        F.count("*").alias("n"), F.max("id").alias("keep"),
    ).join(repeated, "h", "left_semi")
    links = entries.where("n = 1").select("h", "sha", "n", "keep").unionByName(
        compared.select("h", F.sha2("body", 256).alias("sha"), "n", "keep")
    )
    placed = _placed(links, slots, depth)
    owners = max(1, math.ceil(entries.count() / PER_OWNER))
    placed = placed.repartitionByRange(owners, "bucket", "h").sortWithinPartitions("bucket", "h", "sha")
    return materialise(placed.select("bucket", "h", "sha", "n", "keep"), "hash-index"), slots, depth


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id`` (largest id of equal texts), ``group_size``, ``kept``, ``text_sha256``."""
    body = text_of(text)
    rows = materialise(docs.select(F.col(ident).alias("id"), _hash(body, bits).alias("h"), F.sha2(body, 256).alias("sha")), "hash-rows")
    texts = docs.select(F.col(ident).alias("id"), body.alias("body")).withColumn("h", _hash(F.col("body"), bits))
    index, slots, depth = build_index(rows, texts, capacity)
    at = lambda df: df.select(F.struct("bucket", "h", "sha").alias("at"), *[c for c in df.columns if c not in ("bucket", "h", "sha")])
    found = attach_groups(at(_placed(rows, slots, depth)), at(index), "at", "n")
    kept = F.col("id").eqNullSafe(F.col("keep")).alias("kept")
    return found.select(
        F.col("id").alias(ident), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), kept,
        F.col("at.sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row, of the largest id, for each text.  A row is told by its id and text, not by its id alone."""
    groups = exact_groups(docs, ident, text)
    return surviving(
        docs, ident, text,
        groups.select(F.col(ident).alias("id"), F.col("text_sha256").alias("sha"), "kept", F.col("group_size").alias("copies")),
    )

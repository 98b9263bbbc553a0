"""Values of subtrees that outlive a batch of expressions.

A value is known by what it is made of: the digest of its panel, and the text of its expression.  ``Values.evaluate`` looks up the largest
known subtrees of a batch, joins their columns to the panel as if they were leaves, computes the rest, and writes it, together with every
subtree along time or across symbols, as one table.  Tables that were not used for the longest time go when all of them exceed the budget.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ts import SYM, T
from .compiler import evaluate
from .expr import Node
from .registry import OPERATORS

_INDEX = "digest string, column string, table string, bytes long, event long, kind string"


def column_of(digest: str, node: Node) -> str:
    return "v" + hashlib.sha256(f"{digest}\n{node}".encode()).hexdigest()[:24]


def substituted(node: Node, known: dict[Node, str]) -> Node:
    """``node`` with its largest known subtrees as leaves."""
    if node in known:
        return Node(known[node])
    return Node(node.op, tuple(substituted(a, known) for a in node.args)) if node.args else node


class Values:
    """A store of values below ``path``, of at most ``budget`` bytes."""

    def __init__(self, spark: SparkSession, path: str, budget: int):
        self.spark, self.path, self.budget = spark, path, budget

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _log(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _INDEX).coalesce(1).write.mode("append").json(f"{self.path}/index")

    def tables(self) -> list[dict]:
        """The tables that are there, one entry each: digest, columns, bytes, and when it was used last.  As many as batches, within the budget."""
        files, at = self._files(f"{self.path}/index")
        if not files.exists(at):
            return []
        log = self.spark.read.schema(_INDEX).json(f"{self.path}/index")
        found = log.groupBy("table").agg(
            F.max("event").alias("used"), F.max("bytes").alias("bytes"), F.max("digest").alias("digest"), F.collect_set("column").alias("columns"),
            F.max((F.col("kind") == "gone").cast("int")).alias("gone"),
        )
        return [r.asDict() for r in found.where("gone = 0").collect()]

    def evaluate(self, panel: DataFrame, digest: str, expressions: dict[str, Node]) -> DataFrame:
        """What :func:`compiler.evaluate` gives; ``digest`` tells the panel and its range of rows."""
        tables = self.tables()
        clock = max([t["used"] for t in tables], default=0) + 1
        where = {c: t for t in tables if t["digest"] == digest for c in t["columns"]}
        nodes = {n for e in expressions.values() for n in e.walk() if n.args}
        known = {n: c for n in nodes if (c := column_of(digest, n)) in where}
        rest = {k: substituted(e, known) for k, e in expressions.items()}
        used = {n.op for e in rest.values() for n in e.walk()} & set(known.values())
        frame, read = panel, {}
        for c in used:
            read.setdefault(where[c]["table"], []).append(c)
        for table, columns in sorted(read.items()):
            frame = frame.join(self.spark.read.parquet(f"{self.path}/{table}").select(SYM, T, *columns), [SYM, T], "left")
        # the subtrees that cost something, told by the original nodes, are kept beside the results
        kept = {column_of(digest, n): substituted(n, known) for n in nodes if n not in known and OPERATORS[n.op].axis != "row"}
        kept |= {column_of(digest, e): rest[k] for k, e in expressions.items() if e.args and e not in known}
        if read:
            self._log([(digest, None, t, 0, clock, "used") for t in read])
        if kept:
            table = f"values-{uuid.uuid4().hex}"
            evaluate(frame, kept).repartition(SYM).sortWithinPartitions(SYM, T).write.parquet(f"{self.path}/{table}")
            files, at = self._files(f"{self.path}/{table}")
            size = files.getContentSummary(at).getLength()
            self._log([(digest, c, table, size, clock, "made") for c in kept])
            frame = frame.join(self.spark.read.parquet(f"{self.path}/{table}"), [SYM, T], "left")
            self._evict(keep={table, *read})
        out = {k: known.get(e) or (column_of(digest, e) if e.args else e.op) for k, e in expressions.items()}
        return frame.select(SYM, T, *[F.col(c).alias(k) for k, c in out.items()])

    def _evict(self, keep: set[str]) -> None:
        tables = sorted(self.tables(), key=lambda t: t["used"])
        total = sum(t["bytes"] for t in tables)
        for t in tables:
            if total <= self.budget or t["table"] in keep:
                continue
            files, at = self._files(f"{self.path}/{t['table']}")
            files.delete(at, True)
            self._log([(t["digest"], None, t["table"], 0, 0, "gone")])
            total -= t["bytes"]

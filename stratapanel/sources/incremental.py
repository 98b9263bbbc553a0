"""Factors that follow a growing panel: only what new or changed rows can reach is computed again.

A panel lies in parts of ``span`` dates, a folder each.  The digest of a part is taken from its files' names, sizes and times of change, which a
listing gives.  Values lie in parts of the same dates.  A part is dirty when its digest is not the one its values were made from, or when a dirty
part lies within the look-back of the expressions before it; with exponential averages, when any earlier part is dirty.  Dirty parts are
computed from the rows of their own dates and of the look-back before them; exponential averages go on from the states that were kept with the
part before, so that they need no older rows either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scan import scan, scans
from ..functions.ts import SYM, T
from ..plans.compiler import evaluate
from ..plans.expr import Node, bare
from ..plans.registry import OPERATORS
from ..plans.reuse import substituted


def look_back(node: Node) -> int:
    """Rows before a date that its value depends on; exponential averages count none, as they go on from a state."""
    own = 0
    if node.args and bare(node.op) != "ema":
        op = OPERATORS[node.op]
        own = 0 if op.window is None else op.window if bare(node.op) in ("ts_delay", "ts_delta") else op.window - 1
    return own + max((look_back(a) for a in node.args), default=0)


def averages(expressions: dict[str, Node]) -> list[Node]:
    """The exponential averages in a batch, the inner ones first."""
    found = {n for e in expressions.values() for n in e.walk() if bare(n.op) == "ema"}
    return sorted(found, key=lambda n: (n.depth, str(n)))


def keep_parts(panel: DataFrame, path: str, span: int) -> None:
    """Write rows of a panel as parts of ``span`` dates, replacing the parts that they belong to."""
    rows = panel.withColumn("part", F.floor(F.col(T) / span).cast("int")).repartition("part").sortWithinPartitions(T, SYM)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def digests(spark: SparkSession, path: str) -> dict[int, str]:
    """A digest per part, from the listing of its files; one entry per part of the calendar."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
    part = F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("int")
    one = F.sha2(F.concat_ws("|", F.regexp_extract("path", "[^/]+$", 0), "length", F.unix_micros("modificationTime")), 256)
    marks = files.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ""), 256).alias("mark"))
    return {r["part"]: r["mark"] for r in marks.collect()}


class Factors:
    """Values of ``expressions`` over the panel parts at ``panel_path``, kept below ``path``."""

    def __init__(self, spark: SparkSession, panel_path: str, path: str, expressions: dict[str, Node], span: int):
        self.spark, self.panel_path, self.path, self.expressions, self.span = spark, panel_path, path, expressions, span
        self.averages = averages(expressions)
        if any(bare(m.op) == "ema" for n in self.averages for a in n.args for m in a.walk()):
            raise ValueError("averages of averages are not kept up")
        # rows that a part needs before it: for the expressions, and for what averages are taken of
        self.back = max((look_back(e) for e in expressions.values()), default=0)

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _made(self) -> dict[int, str]:
        if not self._there(f"{self.path}/manifest"):
            return {}
        log = self.spark.read.schema("part int, mark string, at long").json(f"{self.path}/manifest")
        return {r["part"]: r["m"] for r in log.groupBy("part").agg(F.max_by("mark", "at").alias("m")).collect()}

    def dirty(self) -> tuple[list[int], dict[int, str]]:
        """The parts to compute, and the digests of all."""
        now, made = digests(self.spark, self.panel_path), self._made()
        changed = [p for p in sorted(now) if made.get(p) != now[p]]
        if not changed:
            return [], now
        reach = -(-self.back // self.span)
        hit = {p for c in changed for p in range(c, c + reach + 1)} if not self.averages else set(range(changed[0], max(now) + 1))
        return [p for p in sorted(now) if p in hit], now

    def update(self) -> list[tuple[int, int]]:
        """Bring the values up to date; the ranges of parts (first, last) that were computed."""
        parts, now = self.dirty()
        ranges: list[tuple[int, int]] = []
        for p in parts:
            ranges = [*ranges[:-1], (ranges[-1][0], p)] if ranges and ranges[-1][1] == p - 1 else [*ranges, (p, p)]
        for first, last in ranges:
            self._compute(first, last)
            rows = [(p, now[p]) for p in range(first, last + 1) if p in now]
            made = self.spark.createDataFrame(rows, "part int, mark string").withColumn("at", F.unix_micros(F.current_timestamp()))
            made.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return ranges

    def _compute(self, first: int, last: int) -> None:
        start = first * self.span
        oldest = (start - self.back) // self.span
        frame = self.spark.read.parquet(self.panel_path).where((F.col("part") >= oldest) & (F.col("part") <= last)).where(F.col(T) >= start - self.back)
        columns: dict[Node, str] = {}
        states = None
        if self.averages:
            sources = {f"x{i}": n.args[0] for i, n in enumerate(self.averages)}
            given = evaluate(frame, sources).where(F.col(T) >= start)
            if first > 0 and self._there(f"{self.path}/states/part={first - 1}"):
                before = self.spark.read.parquet(f"{self.path}/states/part={first - 1}")
                given = given.join(before, SYM, "left")
            else:
                given = given.withColumns({f"{k}{i}": F.lit(None).cast(t) for i in range(len(sources)) for k, t in (("s", "double"), ("n", "long"))})
            wanted = {f"y{i}": scan("ema", f"x{i}", OPERATORS[n.op].window, 1, start=f"s{i}") for i, n in enumerate(self.averages)}
            told = scans(given, wanted)
            order = Window.partitionBy(SYM).orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
            told = told.withColumns({f"c{i}": F.coalesce(f"n{i}", F.lit(0)) + F.count(f"x{i}").over(order) for i in range(len(sources))})
            part = F.floor(F.col(T) / self.span).cast("int")
            ends = told.groupBy(SYM, part.alias("part")).agg(*[F.max_by(f"{a}{i}", T).alias(f"{b}{i}") for i in range(len(sources)) for a, b in (("y", "s"), ("c", "n"))])
            states = ends.select("part", SYM, *[f"{k}{i}" for i in range(len(sources)) for k in "sn"])
            shown = {f"e{i}": F.when(F.col(f"c{i}") >= OPERATORS[n.op].window, F.col(f"y{i}")) for i, n in enumerate(self.averages)}
            frame = frame.join(told.select(SYM, T, *[c.alias(k) for k, c in shown.items()]), [SYM, T], "left")
            columns = {n: f"e{i}" for i, n in enumerate(self.averages)}
        values = evaluate(frame, {k: substituted(e, columns) for k, e in self.expressions.items()}).where(F.col(T) >= start)
        keep_parts(values, f"{self.path}/values", self.span)
        if states is not None:
            states.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/states")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/values").drop("part")

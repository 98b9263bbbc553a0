"""Tables that are replaced while others read them: data lies in folders that never change, and a log of small JSON rows says which of them count.

A reader takes the log as it is when it opens the table and keeps to the folders it names, so it sees one version whatever is written meanwhile.
A replacement writes its folders first and then appends to the log, in one file; folders that no longer count are removed by :func:`swept`, when
no reader of them is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Log:
    """The log of a table: rows (``at``, ``kind``: add or drop, ``folder``, and further fields), read as the entries that count."""

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path, self.fields = spark, path, f"at long, kind string, folder string, {fields}"

    def add(self, rows: list[tuple]) -> None:
        """Append rows (kind, folder, fields ...) with one time for all; they come into force together, with the file that holds them."""
        latest = max([r["at"] for r in self.rows()], default=0)
        made = self.spark.createDataFrame([(latest + 1, *r) for r in rows], self.fields)
        made.coalesce(1).write.mode("append").json(f"{self.path}/log")

    def rows(self) -> list:
        """All rows: as many as folders were ever written, and dropped."""
        files, at = _files(self.spark, f"{self.path}/log")
        return self.spark.read.schema(self.fields).json(f"{self.path}/log").collect() if files.exists(at) else []

    def held(self) -> list:
        found = self.rows()
        gone = {r["folder"] for r in found if r["kind"] == "drop"}
        return sorted((r for r in found if r["kind"] == "add" and r["folder"] not in gone), key=lambda r: (r["at"], r["folder"]))


def swept(log: Log) -> list[str]:
    """Remove the folders that no longer count; their names."""
    found = log.rows()
    gone = {r["folder"] for r in found if r["kind"] == "drop"}
    removed = []
    for folder in sorted(gone):
        files, at = _files(log.spark, f"{log.path}/{folder}")
        if files.exists(at):
            files.delete(at, True)
            removed.append(folder)
    return removed


def _index(key: str, lows: list) -> Column:
    """In which of the ranges that begin at ``lows`` (sorted) a key lies; keys before the first lie in it."""
    held, steps = F.array(*map(F.lit, lows)), F.array(*[F.lit(1 << k) for k in reversed(range(len(lows).bit_length()))])

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        return F.when((to <= len(lows)) & F.coalesce(F.try_element_at(held, to) <= F.col(key), F.lit(False)), to).otherwise(at)

    return F.greatest(F.aggregate(steps, F.lit(0), step) - 1, F.lit(0))


class KeyedTable:
    """A table in folders by ranges of ``key``; an upsert writes only the folders anew whose range its keys fall into."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.log = Log(spark, path, "low string, rows long")

    def _write(self, rows: DataFrame, index: str, lows: dict[int, object]) -> list[tuple]:
        """Write rows by their ``index``; log rows of the new folders."""
        version = f"v-{uuid.uuid4().hex}"
        rows.repartition(F.col(index)).sortWithinPartitions(index, self.key).write.partitionBy(index).parquet(f"{self.path}/{version}")
        counts = self.spark.read.parquet(f"{self.path}/{version}").groupBy(index).count().collect()
        return [("add", f"{version}/{index}={r[index]}", str(lows[r[index]]), r["count"]) for r in counts]

    def write(self, rows: DataFrame, folders: int = 16) -> None:
        """Replace everything; keys are dealt to about ``folders`` ranges of as many rows each."""
        dealt = rows.select(self.key).where(F.col(self.key).isNotNull()).repartitionByRange(folders, self.key)
        lows = sorted(r["low"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(self.key).alias("low")).collect())
        old = [("drop", r["folder"], None, None) for r in self.log.held()]
        made = self._write(rows.withColumn("__range", _index(self.key, lows)), "__range", dict(enumerate(lows))) if lows else []
        if made or old:
            self.log.add(made + old)

    def _lows(self, held: list) -> list:
        kind = self._kind
        return [r["low"] if kind == "string" else float(r["low"]) if kind in ("double", "float") else int(r["low"]) for r in held]

    @property
    def _kind(self) -> str:
        return self.read().schema[self.key].dataType.simpleString()

    def upsert(self, rows: DataFrame) -> int:
        """Replace the rows whose keys are in ``rows`` and add the others; the number of folders written anew."""
        held = self.log.held()
        if not held:
            self.write(rows)
            return len(self.log.held())
        lows = self._lows(held)
        order = sorted(range(len(held)), key=lambda i: lows[i])
        held, lows = [held[i] for i in order], [lows[i] for i in order]
        placed = rows.withColumn("__range", _index(self.key, lows))
        hit = [r["__range"] for r in placed.select("__range").distinct().collect()]
        old = self.spark.read.parquet(*[f"{self.path}/{held[i]['folder']}" for i in hit]).withColumn("__range", _index(self.key, lows))
        kept = old.join(rows.select(self.key).distinct(), self.key, "left_anti")
        made = self._write(kept.unionByName(placed, allowMissingColumns=True), "__range", dict(enumerate(lows)))
        self.log.add(made + [("drop", held[i]["folder"], None, None) for i in hit])
        return len(hit)

    def read(self) -> DataFrame:
        """The table as it is now."""
        held = self.log.held()
        if not held:
            raise FileNotFoundError(f"{self.path} holds nothing")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{r['folder']}" for r in held])

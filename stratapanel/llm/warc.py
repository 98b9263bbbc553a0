"""Writing pages as WARC records and reading archives back with boundary-chain verification (DataFrame operations only).

Writing goes through Spark's text writer, whose record separator is the blank line that ends a WARC record: the commit
protocol, retries, compression and remote file systems are Spark's.  Records are dealt to files of about ``FILE_BYTES``.  Of
records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is a response, the others revisit
it.

Reading goes through Spark's text reader with the record magic as separator, so that large plain (or bzip2) files are read by
many tasks, a split each, and every occurrence of the magic, also those inside payloads, starts a row.  Sums of row lengths,
per split and then per file, give each candidate its offset; its stated length gives the offset of its successor.  Candidates
that follow each other directly are one run, and pointer jumping over runs, by joins that double the reach in each round,
keeps those that the chain from the start of the file reaches.  Only payloads that hold a magic are put together again from
several rows.

Cases: null payloads count as empty; null ids are written as an empty field and read back as null; ids of any type are read in the type
they are asked for in, texts, which may hold anything, among them; null or broken URLs are
written without line breaks; repeated rows are records of their own with equal record ids, of which one is the response: those
with the smallest id are all responses; an empty table writes no record and gives an empty result; other columns are not read.
Field names are read in any case, versions 1.0 and 1.1 alike.  Where a chain ends before its file does, a row of the type
``broken`` says where (``at``) and how many bytes follow (``payload_bytes``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach_groups, likely_among, materialise

MIN_REVISIT = 100
#: Bytes of records, before compression, that a file holds, about.
FILE_BYTES = 32 << 20
MAGIC = "WARC/1."
_LINE = "\r\n"
_STEP = len(MAGIC)


def _record_id(ident: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _id_text(ident: Column, kind: str) -> Column:
    """An id as one line of a header: texts are percent-encoded, an empty one is a pair of quotes; null gives null."""
    return F.when(ident == "", '""').otherwise(F.url_encode(ident)) if kind == "string" else ident.cast("string")


def _id_value(text: Column, kind: str) -> Column:
    return F.when(text != '""', F.try_url_decode(text)).when(text == '""', "") if kind == "string" else text.try_cast(kind)


def plan_records(pages: DataFrame, ident: str = "page_id", payload: str = "html", uri: str = "url") -> DataFrame:
    """Rows ``id, uri, body, n, sha, refers``: which record each page becomes (``refers`` is null for a response)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(ident).alias("id"), F.col(uri).alias("uri"), body.alias("body"), F.octet_length(body).cast("long").alias("n"),
        F.sha2(body, 256).alias("sha"),
    )
    slim = materialise(rows.select("id", "n", "sha"), "warc-digests")
    groups = materialise(
        slim.where(F.col("n") >= MIN_REVISIT).groupBy("sha").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "warc-groups",
    )
    again = slim.where(F.col("n") >= MIN_REVISIT).select("id", "sha")
    again = attach_groups(again, groups.where("copies > 1"), "sha", "copies").where(F.col("id") != F.col("first"))
    again = again.select("id", "sha", F.col("first").alias("refers")).distinct()
    held = slim.agg(F.sum("n"), F.count("*")).head()
    # with fewer parts than the session's, Spark would deal the bodies a second time for the join
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(((held[0] or 0) + 600 * held[1]) / FILE_BYTES))
    return rows.repartition(files, "id", "sha").join(again.repartition(files, "id", "sha"), ["id", "sha"], "left")


def write_archives(
    pages: DataFrame, path: str, ident: str = "page_id", payload: str = "html", uri: str = "url", date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write one record per page below ``path``."""
    rows = plan_records(pages, ident, payload, uri)
    kind = rows.schema["id"].dataType.simpleString()
    revisit = F.col("refers").isNotNull()
    fields = [
        ("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID: ", _record_id(F.col("id"))),
        ("WARC-Date: ", F.lit(date)),
        ("WARC-Target-URI: ", F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", " ")),
        ("WARC-Payload-Digest: sha256:", F.col("sha")),
        ("X-Page-Id: ", F.coalesce(_id_text(F.col("id"), kind), F.lit(""))),
        ("X-Payload-Length: ", F.col("n").cast("string")),
    ]
    lines = [F.concat(F.lit(k), v) for k, v in fields]
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _LINE
    lines.append(
        F.when(
            revisit,
            F.concat(
                F.lit(profile + "WARC-Refers-To: "), _record_id(F.col("refers")), F.lit(_LINE + "X-Refers-To-Page: "),
                _id_text(F.col("refers"), kind),
            ),
        )
    )
    lines.append(
        F.concat(F.lit("Content-Type: text/html" + _LINE + "Content-Length: "), F.when(revisit, 0).otherwise(F.col("n")).cast("string"))
    )
    head = F.concat_ws(_LINE, F.lit("WARC/1.1"), *lines)
    value = F.concat(head, F.lit(_LINE * 2), F.when(revisit, "").otherwise(F.col("body")))
    rows.select(value.alias("value")).write.option("lineSep", _LINE * 2).option("compression", "gzip").text(path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magics: ``file, block, turn, value, size``; ``turn`` rises within a split."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return rows.select(*at, F.monotonically_increasing_id().alias("turn"), "value", F.octet_length("value").cast("long").alias("size"))


def _with_offsets(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """``rows`` (file, block, turn, size ...) with ``start``, the offset of what follows the magic; ``slim`` has the sizes of all rows of the files."""
    blocks = slim.groupBy("file", "block").agg(F.sum(F.col("size") + _STEP).alias("all"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum(F.col("size") + _STEP).over(inside) - F.col("size") - _STEP)
    return rows.join(blocks, ["file", "block"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _whole(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]{1,18}$"), text.cast("long"))


def _payload(value: str, at: Column, length: Column) -> tuple[Column, Column]:
    """Digest of the payload in the bytes of a record, and whether the blank line follows it."""
    body = F.col(value).cast("binary")
    blank = F.substring(body, (at + length + 1).cast("int"), F.lit(4)) == F.lit((_LINE * 2).encode())
    return F.sha2(F.substring(body, (at + 1).cast("int"), length.cast("int")), 256), blank


def _candidates(parts: DataFrame, id_type: str) -> DataFrame:
    """One slim row per part: the fields of the header it may begin with, and the digest of a payload that lies within it."""
    rows = parts.withColumn("head", F.substring_index("value", _LINE * 2, 1))
    told = F.col("value").rlike(r"\A[01]\r\n") & (F.octet_length("head") < F.col("size"))
    length = F.when(told, _whole(_field("Content-Length")))
    rows = rows.withColumns({"told": told, "length": F.when(length >= 0, length), "body": (F.octet_length("head") + 4).cast("long")})
    digest, blank = _payload("value", F.col("body"), F.col("length"))
    inside = F.col("body") + F.col("length") <= F.col("size")
    page = [
        F.lower(_field("WARC-Type")).alias("kind"), _id_value(_field("X-Page-Id"), id_type).alias("page_id"),
        _id_value(_field("X-Refers-To-Page"), id_type).alias("refers_to"),
    ]
    said = [
        _field("WARC-Payload-Digest").alias("said"), _whole(_field("X-Payload-Length")).alias("full"),
        _field("WARC-Target-URI").alias("uri"),
    ]
    held = [F.xxhash64("value").alias("mark"), F.when(inside, digest).alias("digest"), F.when(inside, blank).alias("blank")]
    return rows.select("file", "block", "turn", "size", "told", "length", "body", *page, *said, *held)


def _runs(rows: DataFrame) -> DataFrame:
    """``rows`` of candidates with ``run``: a run's candidates follow each other directly, and jumps lead to first ones only."""
    order = Window.partitionBy("file").orderBy("start")
    closed = F.col("told") & F.coalesce("blank", F.lit(False)) & (F.col("next") == F.col("start") + F.col("size"))
    rows = rows.withColumn("solid", closed & F.coalesce(F.lead("told").over(order), F.lit(False)))
    aims = rows.where("told and not solid and next is not null").select(
        "file", F.col("next").alias("at"), F.lit(True).alias("aimed"),
    ).distinct()
    rows = rows.join(aims, ["file", "at"], "left")
    first = F.col("told") & (F.col("aimed").isNotNull() | ~F.coalesce(F.lag("solid").over(order), F.lit(False)))
    return rows.withColumn("run", F.sum(first.cast("long")).over(order)).where("told").drop("aimed")


def _reached(runs: DataFrame) -> DataFrame:
    """``file, at`` of the runs that the chain from the start of the file reaches; ``runs`` has file, at and exit."""
    heads = runs.select("file", F.col("at").alias("exit"))
    jump = materialise(runs.select("file", "at", "exit").join(heads, ["file", "exit"], "left_semi").where("exit > at"), "warc-jumps")
    reach = materialise(runs.where("at = 0").select("file", "at"), "warc-reach")
    count = reach.count()
    while jump.head(1):
        on = reach.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reach = materialise(reach.unionByName(on).distinct(), "warc-reach")
        before, count = count, reach.count()
        if count == before:
            break
        ahead = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jump = materialise(jump.join(ahead, ["file", "exit"]).select("file", "at", F.col("far").alias("exit")), "warc-jumps")
    return reach


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records of all archives below ``path``, with offsets; ``intact`` says that boundary and digest hold.  Ids are read as ``id_type``."""
    fat = materialise(_candidates(_parts(spark, path), id_type), "warc-candidates")
    # the chains are followed on narrow rows, in which files go by a hash of their name
    narrow = fat.select(
        F.xxhash64("file").alias("file"), "block", "turn", "size", "told", "length", "body", "blank", "mark",
        F.col("digest").isNotNull().alias("inside"),
    )
    rows = _with_offsets(narrow, narrow).withColumns(
        {"at": F.col("start") - _STEP, "next": F.col("start") + F.col("body") + F.col("length") + 4}
    )
    rows = materialise(rows, "warc-offsets")
    ends = materialise(rows.groupBy("file").agg(F.max(F.col("start") + F.col("size")).alias("end")), "warc-ends")
    marks = rows.select("file", "start", "mark")
    rows = materialise(_runs(rows.drop("mark")), "warc-rows")
    runs = materialise(
        rows.groupBy("file", "run").agg(F.min("at").alias("at"), F.max_by("next", "start").alias("exit"), F.max("at").alias("last")),
        "warc-runs",
    )
    reached = materialise(runs.join(_reached(runs), ["file", "at"]), "warc-reached")
    records = rows.join(reached.select("file", "run"), ["file", "run"])
    long_ = records.where("not inside and length is not null").join(ends, "file").where("next <= end")
    far = {"far_digest": F.lit(None).cast("string"), "far_blank": F.lit(None).cast("boolean")}
    records = records.join(
        _put_together(spark, path, marks, long_), ["file", "start"], "left",
    ) if long_.head(1) else records.withColumns(far)
    records = records.select(F.col("file").alias("fid"), "block", "turn", "at", "next", "far_digest", "far_blank")
    full = fat.withColumn("fid", F.xxhash64("file")).join(records, ["fid", "block", "turn"])
    full = full.withColumns({"digest": F.coalesce("digest", "far_digest"), "blank": F.coalesce("blank", "far_blank")})
    again = F.col("kind") == "revisit"
    told = F.regexp_replace("said", "^(?i)sha256:", "")
    kept = F.coalesce("blank", F.lit(False)) & (
        again | ~F.coalesce(F.col("said").rlike("(?i)^sha256:"), F.lit(False)) | F.coalesce(told == F.col("digest"), F.lit(False))
    )
    found = full.select(
        "file", "at", "next", F.coalesce("kind", F.lit("")).alias("record_type"), "page_id", "refers_to", F.when(again, F.col("full")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(again, told).otherwise(F.col("digest")).alias("payload_digest"), F.coalesce("uri", F.lit("")).alias("uri"), kept.alias("intact"),
    )
    broken = _broken(ends, runs, reached)
    names = fat.select("file", F.xxhash64("file").alias("fid")).distinct()
    broken = broken.withColumnRenamed("file", "fid").join(names, "fid").drop("fid")
    return found.unionByName(broken, allowMissingColumns=True)


def _broken(ends: DataFrame, runs: DataFrame, reached: DataFrame) -> DataFrame:
    """A row for each file whose chain ends before the file does."""
    heads = reached.select("file", F.col("at").alias("exit"))
    stops = reached.join(heads, ["file", "exit"], "left_anti").groupBy("file").agg(F.max(F.coalesce("exit", "last")).alias("at"))
    rest = ends.join(stops, "file", "left").withColumn("at", F.coalesce("at", F.lit(0).cast("long"))).where(
        (F.col("at") != F.col("end")) & (F.col("end") > 0)
    )
    return rest.select(
        "file", "at", F.lit("broken").alias("record_type"), (F.col("end") - F.col("at")).alias("payload_bytes"),
        F.lit(False).alias("intact"),
    )


def _put_together(spark: SparkSession, path: str, marks: DataFrame, long_: DataFrame) -> DataFrame:
    """``file, start, far_digest, far_blank`` of records whose payload holds the magic and so lies in several parts.

    ``marks`` has the offset and the hash of every part.  Only the parts of such records are read again, each content once.
    """
    long_ = materialise(
        long_.select("file", "start", F.struct(F.col("start").alias("of"), F.col("next").alias("until"), "body", "length").alias("r")),
        "warc-long",
    )
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = marks.join(long_, ["file", "start"], "left").withColumn(
        "r", F.last("r", ignorenulls=True).over(order),
    ).where("start < r.until")
    pieces = materialise(pieces, "warc-pieces")
    content = _parts(spark, path).select("value", F.xxhash64("value").alias("mark"))
    content = likely_among(content, pieces.select("mark").distinct(), "mark").groupBy("mark").agg(F.any_value("value").alias("value"))
    whole = pieces.join(content, "mark").groupBy("file", "r").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    whole = whole.select("file", "r", F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value"))
    digest, blank = _payload("value", F.col("r.body"), F.col("r.length"))
    return whole.select("file", F.col("r.of").alias("start"), digest.alias("far_digest"), blank.alias("far_blank"))

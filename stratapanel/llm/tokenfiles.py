"""Token ids of documents in flat binary files.

``write_tokens`` deals documents to files by ranges of their id (ties by a hash of the text, then by place), so that the files in order
hold the documents in order.  Each file is written by one task, next to the encoding, so that ids are never stored or moved otherwise:

* ``ids-N.bin``: the ids of all documents behind each other, each document's end marked by ``end``; unsigned little-endian integers of
  16 bits where the vocabulary allows it, else of 32;
* ``offsets-N.bin``: signed 64-bit little-endian integers, where each document begins within the file, and the file's length;
* ``keys-N.arrow``: the documents' ids, of any type, as an Arrow file;
* ``parts``: a table with a row per file.  Its base, the number of ids in all files before it, is a prefix sum over this table.

``read_tokens`` maps the files into memory, a range of documents per task.  A task that is run again writes the same bytes under a name of
its own and moves them into place, so lost executors and repeated attempts do no harm.

Texts are cut in front of single spaces that a visible character follows, and where a mark or a line feed follows a letter.  No token of a
byte-level vocabulary crosses such a place, so each distinct cut goes to the tokenizers library once per worker and batch, and once in all
while the worker remembers it.  Vocabularies of other kinds get whole texts.

Cases: null and empty texts have no ids but the end; null document ids come first; repeated rows are documents of their own; an empty table
writes an empty table of parts and reads back as one; other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Bytes of ids that a file holds, about, and documents that a task reads at once.
FILE_BYTES = 64 << 20
READ_DOCS = 20_000
#: Cuts that a worker remembers, none longer than LONG characters: those of the last time and those of the time before, which give way.
KEEP = 800_000
LONG = 40
_ROW = 400
#: Bytes of text that are encoded at once, at least.
TEXT_BYTES = 8 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> dict:
    """A vocabulary to be broadcast: the library's JSON text, whether texts may be cut, and a memory that each worker fills."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    told = json.loads(text)
    how = told.get("pre_tokenizer") or {}
    plain = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space")
    ids = [*(told["model"]["vocab"]).values(), *(t["id"] for t in told.get("added_tokens", []))]
    fixed = not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in told.get("added_tokens", []))
    cut = bool(plain and fixed and not told.get("normalizer"))
    spelled = np.zeros(max(ids) + 1, np.int64)  # bytes that each id stands for; a byte-level token has a character per byte
    if cut:
        for x, i in told["model"]["vocab"].items():
            spelled[i] = len(x)
        for t in told.get("added_tokens", []):
            spelled[t["id"]] = len(t["content"].encode())
    return {"json": text, "cut": cut, "spelled": spelled, "largest": max(ids), "memory": {}}


def width_of(vocabulary: dict, end: int) -> str:
    return "<u2" if max(vocabulary["largest"], end) < 1 << 16 else "<u4"


#: Kinds of bytes: 1 space, 2 line feed, 3 visible, 4 mark that ends a word, 5 letter or digit, 6 first byte of a letter from U+00C0 to U+00FF.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0x20, 0x0A, 0xC3]] = [1, 2, 6]
_KIND[list(b",.;:!?)(")] = 4
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 5


def _cuts(texts: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """The texts' cuts, and the number of cuts before each text (and in all)."""
    texts = pa.concat_arrays([texts])  # its own buffers, from their beginning
    ends = np.frombuffer(texts.buffers()[1], np.int32)[:len(texts) + 1]
    if not cut or texts.buffers()[2] is None:
        return texts, np.arange(len(texts) + 1)
    data = _KIND[np.frombuffer(texts.buffers()[2], np.uint8)[:ends[-1]]]
    here, after = data[:-1], data[1:]
    at = np.zeros(len(data) + 1, bool)
    at[:-2] = (here == 1) & (after >= 3)
    at[1:-1] |= ((here == 5) & (after == 4)) | ((here >= 4) & (here < 6) & (after == 2))
    at[ends] = True
    starts = np.flatnonzero(at[:-1]).astype(np.int32)
    bounds = np.append(starts, ends[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), texts.buffers()[2]), np.searchsorted(starts, ends)


def _encoded(vocabulary: dict, new: list[str], kind: str) -> dict[str, bytes]:
    """The ids of texts.  Cuts that begin with a space are encoded many in a row, and told apart by the bytes their ids stand for."""
    tokenizer, made = vocabulary["memory"]["tokenizer"], {}
    rowed = [x for x in new if vocabulary["cut"] and len(x) > 1 and x[0] == " " and ("!" <= x[1] <= "~" or "À" <= x[1] <= "ÿ")]
    rows = [rowed[at:at + _ROW] for at in range(0, len(rowed), _ROW)]
    for row, e in zip(rows, tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False), strict=True):
        ids = np.array(e.ids)
        reached = np.cumsum(vocabulary["spelled"][ids])
        ends = np.cumsum([len(x.encode()) for x in row])
        at = np.searchsorted(reached, ends)
        if not np.array_equal(reached[at], ends):
            raise ValueError("a token crosses a cut")
        flat, to = ids.astype(kind).tobytes(), ((at + 1) * np.dtype(kind).itemsize).tolist()
        made |= zip(row, [flat[a:b] for a, b in zip([0, *to], to, strict=False)], strict=True)
    alone = [x for x in new if x not in made]
    made |= {x: np.array(e.ids, kind).tobytes() for x, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True)}
    return made


def encode_texts(vocabulary: dict, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts behind each other, and how many each has."""
    memory = vocabulary["memory"]
    if "tokenizer" not in memory:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        memory |= {"tokenizer": Tokenizer.from_str(vocabulary["json"]), "known": {}, "before": {}}
    if len(memory["known"]) > KEEP // 2:
        memory |= {"known": {}, "before": memory["known"]}
    known, older = memory["known"], memory["before"]
    pieces, before = _cuts(texts, vocabulary["cut"])
    if not len(pieces):
        return np.zeros(0, kind), np.zeros(len(texts), np.int64)
    coded = pieces.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = [known.get(x) or older.get(x) for x in distinct]
    made = _encoded(vocabulary, [x for x, ids in zip(distinct, found, strict=True) if ids is None], kind)
    found = [ids or made[x] for x, ids in zip(distinct, found, strict=True)]
    known.update((x, ids) for x, ids in zip(distinct, found, strict=True) if len(x) <= LONG)
    flat, size = np.frombuffer(b"".join(found), kind), np.array([len(x) for x in found], np.int64) // np.dtype(kind).itemsize
    which = coded.indices.to_numpy()
    first, count = (np.cumsum(size) - size)[which], size[which]
    reached = np.concatenate([[0], np.cumsum(count)])
    ids = flat[np.arange(reached[-1]) + np.repeat(first - reached[:-1], count)]
    return ids, np.diff(reached[before])


def _with_ends(ids: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(count), end)


class Folder:
    """Files below a path that all tasks share: local or mounted ones are mapped into memory, others read by ranges."""

    def __init__(self, path: str):
        from pyarrow import fs

        told = urlparse(path)
        self.local = told.scheme in ("", "file")
        self.files, self.path = (fs.LocalFileSystem(), told.path) if self.local else fs.FileSystem.from_uri(path)
        self.files.create_dir(self.path, recursive=True)

    def name(self, kind: str, part: int) -> str:
        return f"{self.path}/{kind}-{part:06d}.{'arrow' if kind == 'keys' else 'bin'}"

    def open(self, kind: str, part: int) -> pa.NativeFile:
        name = self.name(kind, part)
        return pa.memory_map(name) if self.local else self.files.open_input_file(name)


def _values(file: pa.NativeFile, kind: str, first: int, last: int) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.frombuffer(file.read_at((last - first) * n, first * n), kind)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The columns of batches that follow each other, in runs of TEXT_BYTES or little more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= TEXT_BYTES:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


KINDS = ("ids", "offsets", "keys")


def write_tokens(
    docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write the ids of all documents below ``path``, in ascending order of ``ident``."""
    spark = docs.sparkSession
    small_batches(spark)
    loaded = load(vocabulary or default_vocabulary())
    kind = width_of(loaded, end)
    held = spark.sparkContext.broadcast(loaded)
    rows = docs.select(F.col(ident).alias("id"), text_of(text).alias("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).head()
    # a token has some three bytes of text, and two or four bytes here
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(((size or 0) + 32 * count) / file_bytes))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.xxhash64(F.monotonically_increasing_id())})
    ordered = rows.repartitionByRange(files, "id", "tie", "place").sortWithinPartitions("id", "tie", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, part, tag, out = Folder(path), TaskContext.get().partitionId(), uuid.uuid4().hex, None
        names = {k: f"{folder.name(k, part)}.{tag}" for k in KINDS}
        tokens = documents = 0
        for names_of, texts in _merged(batches):
            if out is None:
                out = {k: folder.files.open_output_stream(n) for k, n in names.items()}
                keys = pa.ipc.new_file(out["keys"], pa.schema([("id", names_of.type)]))
                out["offsets"].write(np.zeros(1, "<i8").tobytes())
            ids, size = encode_texts(held.value, texts, kind)
            keys.write_batch(pa.RecordBatch.from_arrays([names_of], names=["id"]))
            out["ids"].write(_with_ends(ids, size, end).astype(kind).tobytes())
            out["offsets"].write((tokens + np.cumsum(size + 1)).astype("<i8").tobytes())
            documents, tokens = documents + len(texts), tokens + len(ids) + len(texts)
        if out is not None:
            keys.close()
            for k in KINDS:
                out[k].close()
                folder.files.move(names[k], folder.name(k, part))
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [documents], "tokens": [tokens]})

    parts = ordered.select("id", "text").mapInArrow(write, "part long, docs long, tokens long")
    said = {"kind": kind, "id_type": rows.schema["id"].dataType.simpleString(), "id_name": ident}
    parts.write.parquet(f"{path}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = spark.read.schema("part long, docs long, tokens long").parquet(f"{path}/parts").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    based.write.parquet(f"{path}/bases")
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in said.items()]).write.parquet(f"{path}/format")


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document, read from the files: its id, ``start`` (ids of all documents before it), ``n_tokens`` (with the end),
    ``ids_crc32`` (of the ids as little-endian 32-bit integers) and, on request, the ``ids`` themselves."""
    said = spark.read.parquet(f"{path}/format").head()
    kind, id_name = said["kind"], said["id_name"]
    based = spark.read.schema("part long, docs long, tokens long, base long").parquet(f"{path}/bases")
    slices = based.select("part", "base", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first"))
    slices = slices.repartition(max(1, min(slices.count(), 10_000)), "part", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                part, first, last = row["part"], row["first"], min(row["docs"], row["first"] + READ_DOCS)
                with folder.open("ids", part) as flat, folder.open("offsets", part) as at, folder.open("keys", part) as keys:
                    names = pa.ipc.open_file(keys).read_all().column(0).slice(first, last - first)
                    ends = _values(at, "<i8", first, last + 1)
                    for a in range(0, last - first, 1000):
                        b = min(a + 1000, last - first)
                        found = [_values(flat, kind, x, y) for x, y in zip(ends[a:b], ends[a + 1:b + 1], strict=True)]
                        out = [
                            names.slice(a, b - a).combine_chunks(), pa.array(row["base"] + ends[a:b]), pa.array(np.diff(ends[a:b + 1])),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        ]
                        out += [pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))] * ids
                        yield pa.RecordBatch.from_arrays(out, names=["id", "start", "n_tokens", "ids_crc32", *(["ids"] * ids)])

    schema = f"id {said['id_type']}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return slices.mapInArrow(read, schema).withColumnRenamed("id", id_name)

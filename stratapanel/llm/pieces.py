"""SentencePiece encoding and decoding with N-best segmentation.

The pieces that match a text form a lattice; a segmentation is a path and its score the sum of its pieces' scores.  Forward
Viterbi gives the best score from the start to every node.  A-star then searches backward from the end: the score behind a
partial path plus the Viterbi score of its node is exact, so complete paths come off the queue in order of score.

Texts are cut between two characters that are neighbours in no piece of the vocabulary, and each distinct cut goes through
Viterbi once per worker, which also tells what its second choice loses.  The N best segmentations of a text differ from the best
one only in cuts that are among the N - 1 with the smallest loss: A-star finds the choices of these, and a lattice of the choices
goes through the same search.

Spaces are written as U+2581, with one in front of the text, as the model asks.  What no piece covers, and U+2581 itself, is
spelled in byte pieces at a score below all others, so decoding gives back every text exactly.

Cases: null and empty texts have no pieces (score 0) and decode to the empty text; repeated rows are encoded alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .textvec import chunks, run_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\udc81"
#: Distinct cuts that a worker keeps; the memory is emptied when it is full.
KEEP = 400_000
_LONG = 48
_CHARS = 600_000


def load(path: str = MODEL) -> dict:
    """The vocabulary as plain values, to be broadcast: a few MB whatever the input."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [i for i in range(n) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i) or p.is_unused(i))]
    pieces = {p.id_to_piece(i): (i, p.get_score(i)) for i in plain}
    by_byte = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
    text = {i: s.replace(SPACE, " ").encode() for s, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in by_byte.items()}
    return {
        "pieces": pieces, "bytes": [by_byte.get(b, p.unk_id()) for b in range(256)], "text": [text.get(i, b"") for i in range(n)],
        "longest": max(map(len, pieces)), "spelled": min(s for _, s in pieces.values()) - 10.0,
        "lengths": _lengths(pieces),
    } | _reach(pieces)


def n_best(arriving: list[list[tuple[int, float, object]]], n: int) -> list[tuple[float, list]]:
    """The n best paths from node 0 to the last node; ``arriving[j]`` lists (from, score, label) of the edges into node j < len."""
    best = [0.0] + [float("-inf")] * (len(arriving) - 1)
    for j in range(1, len(arriving)):
        best[j] = max((best[i] + s for i, s, _ in arriving[j]), default=float("-inf"))
    end = len(arriving) - 1
    found, count = [], 0
    queue = [(-best[end], end, 0, 0.0, None)]
    while queue and len(found) < n:
        _, at, _, behind, path = heapq.heappop(queue)
        if at == 0:
            labels = []
            while path:
                label, path = path
                labels.append(label)
            found.append((behind, labels))
            continue
        for i, s, label in arriving[at]:
            count += 1
            heapq.heappush(queue, (-(behind + s + best[i]), i, count, behind + s, (label, path)))
    return found


def _arriving(vocab: dict, cut: str) -> list[list[tuple[int, float, tuple]]]:
    pieces, longest, spelled, by_byte = vocab["pieces"], vocab["longest"], vocab["spelled"], vocab["bytes"]
    out: list[list] = [[]]
    for j in range(1, len(cut) + 1):
        edges = []
        for i in range(max(0, j - longest), j):
            hit = pieces.get(cut[i:j])
            if hit:
                edges.append((i, hit[1], (hit[0],)))
        if not edges or edges[-1][0] != j - 1:
            raw = (SPACE if cut[j - 1] == LITERAL else cut[j - 1]).encode("utf-8", "surrogatepass")
            edges.append((j - 1, spelled * len(raw), tuple(by_byte[b] for b in raw)))
        out.append(edges)
    return out


def segment(vocab: dict, cut: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of one cut: (score, piece ids)."""
    return [(score, tuple(i for label in labels for i in label)) for score, labels in n_best(_arriving(vocab, cut), n)]


def forward(vocab: dict, cut: str) -> tuple[list[int], float, float]:
    """Viterbi over one cut: the best piece ids, their score, and what the second-best segmentation loses (infinite if none)."""
    pieces, lengths, by_byte, spelled = vocab["pieces"].get, vocab["lengths"].get, vocab["bytes"], vocab["spelled"]
    n, low = len(cut), float("-inf")
    one, two, back = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1)
    step: list = [None] * (n + 1)
    one[0] = 0.0
    for i in range(n):
        a, b = one[i], two[i]
        found = False
        for size in lengths(cut[i : i + _KEY], _SHORT):
            j = i + size
            if j > n:
                break
            hit = pieces(cut[i:j])
            if hit is None:
                continue
            if size == 1:
                found = True
            s = a + hit[1]
            if s > one[j]:
                if one[j] > two[j]:
                    two[j] = one[j]
                one[j], back[j], step[j] = s, i, hit[0]
            elif s > two[j]:
                two[j] = s
            if b + hit[1] > two[j]:
                two[j] = b + hit[1]
        if not found:
            raw = (SPACE if cut[i] == LITERAL else cut[i]).encode("utf-8", "surrogatepass")
            s, t = a + spelled * len(raw), b + spelled * len(raw)
            if s > one[i + 1]:
                if one[i + 1] > two[i + 1]:
                    two[i + 1] = one[i + 1]
                one[i + 1], back[i + 1], step[i + 1] = s, i, tuple(by_byte[x] for x in raw)
            elif s > two[i + 1]:
                two[i + 1] = s
            if t > two[i + 1]:
                two[i + 1] = t
    parts, at = [], n
    while at:
        parts.append(step[at])
        at = back[at]
    ids: list[int] = []
    for part in reversed(parts):
        ids += part if isinstance(part, tuple) else (part,)
    return ids, one[n], one[n] - two[n]


_KEY = 4
_SHORT = tuple(range(1, _KEY))


def _lengths(pieces: dict) -> dict[str, tuple[int, ...]]:
    """For each beginning of ``_KEY`` characters the lengths that a piece may have there, shorter ones included."""
    out: dict[str, set[int]] = {}
    for x in pieces:
        if len(x) >= _KEY:
            out.setdefault(x[:_KEY], set(_SHORT)).add(len(x))
    return {k: tuple(sorted(v)) for k, v in out.items()}


def _reach(pieces: dict) -> dict:
    """Classes of characters and, for each two classes, whether some piece has such neighbours (class 0: no longer piece has it)."""
    long = [x for x in pieces if len(x) > 1]
    classes = {c: i + 1 for i, c in enumerate(sorted({c for x in long for c in x if ord(c) < 0x10000}))}
    of = np.zeros(0x10000, np.int32)
    of[[ord(c) for c in classes]] = list(classes.values())
    joined = np.zeros((len(classes) + 1, len(classes) + 1), bool)
    for x in long:
        for u, v in zip(x, x[1:]):
            joined[classes.get(u, 0), classes.get(v, 0)] = True
    return {"of": of, "joined": joined}


def new_memory() -> dict:
    """What a worker remembers: the place of each searched cut, its best ids end to end, best scores, losses, and full choices."""
    return {"at": {}, "ids": array("i"), "end": array("q", [0]), "score": array("d"), "loss": array("d"), "choices": {}}


def _view(values: array) -> np.ndarray:
    return np.array(values)  # a copy, as an array with a view can't grow


@dataclass
class Encoding:
    """N-best segmentations of a text; ``others`` holds, for all but the first, {cut: choice}; ``cuts`` the ends of each cut's ids."""

    ids: np.ndarray
    scores: list[float]
    ends: np.ndarray
    others: list[dict[int, tuple[int, ...]]]

    def cut(self, c: int) -> np.ndarray:
        """The best ids of one cut."""
        return self.ids[self.ends[c - 1] if c else 0 : self.ends[c]]

    def edits(self) -> list[list[dict]]:
        """All segmentations but the best as edits of it, each in order of place."""
        span = lambda c: {"start": int(self.ends[c - 1]) if c else 0, "stop": int(self.ends[c])}
        return [[span(c) | {"ids": list(ids)} for c, ids in sorted(other.items())] for other in self.others]

    def nth(self, k: int) -> np.ndarray:
        """The ids of the segmentation of rank ``k``."""
        if not k:
            return self.ids
        out, begun = [], 0
        for cut, ids in sorted(self.others[k - 1].items()):
            out += [self.ids[begun : self.ends[cut - 1] if cut else 0], np.array(ids, self.ids.dtype)]
            begun = self.ends[cut]
        return np.concatenate([*out, self.ids[begun:]])


def encode_batch(vocab: dict, memory: dict, texts: list[str | None], n: int) -> Iterator[Encoding]:
    """The n best segmentations of each text; cuts that ``memory`` doesn't hold are searched."""
    written = [SPACE + (t.replace(SPACE, LITERAL) if SPACE in t else t).replace(" ", SPACE) if t else "" for t in texts]
    whole = "".join(written)
    units = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0] + [len(w) for w in written])
    kind = vocab["of"][np.minimum(units, 0xFFFF)]
    start = np.ones(len(units), bool)
    start[1:] = ~vocab["joined"][kind[:-1], kind[1:]] | (units[:-1] > 0xFFFF) | (units[1:] > 0xFFFF)
    start[bounds[:-1][bounds[:-1] < len(units)]] = True
    start = np.flatnonzero(start)
    end = np.append(start[1:], len(units))
    names, first, which = np.unique(run_hashes(units, start, end), return_index=True, return_inverse=True)
    if len(memory["at"]) > KEEP:
        memory.update(new_memory())
    at, ids, ends, score, loss = (memory[k] for k in ("at", "ids", "end", "score", "loss"))
    place = np.empty(len(names), np.int64)
    for i, name in enumerate(names.tolist()):
        found = at.get(name)
        if found is None:
            found = at[name] = len(score)
            best, total, lost = forward(vocab, whole[start[first[i]] : end[first[i]]])
            ids.extend(best)
            ends.append(len(ids))
            score.append(total)
            loss.append(lost)
        place[i] = found
    place = place[which]
    flat, stop = _view(ids), _view(ends)
    size = (stop[1:] - stop[:-1])[place]
    after = np.concatenate([[0], np.cumsum(size)])
    out = flat[np.repeat(stop[:-1][place] - after[:-1], size) + np.arange(after[-1])]
    scores, losses = _view(score)[place], _view(loss)[place]
    cuts = np.searchsorted(start, bounds)
    for d in range(len(texts)):
        lo, hi = cuts[d], cuts[d + 1]
        mine = losses[lo:hi]
        few = min(n - 1, hi - lo)
        close = np.sort(np.argpartition(mine, few - 1)[:few]) if few > 0 else np.zeros(0, int)
        close = close[np.isfinite(mine[close])]
        lattice: list[list] = [[]]
        for k, c in enumerate(close.tolist()):
            cut = whole[start[lo + c] : end[lo + c]]
            options = memory["choices"].get(cut) or segment(vocab, cut, n)
            if len(cut) <= _LONG:
                memory["choices"][cut] = options
            lattice.append([(k, s - options[0][0], (c, j, i)) for j, (s, i) in enumerate(options)])
        total = float(scores[lo:hi].sum())
        paths = n_best(lattice, n) if hi > lo else [(0.0, [])]
        yield Encoding(
            out[after[lo] : after[hi]], [total + s for s, _ in paths], after[lo + 1 : hi + 1] - after[lo],
            [{c: i for c, j, i in labels if j} for _, labels in paths[1:]],
        )


def encode(vocab: dict, memory: dict, text: str | None, n: int) -> Encoding:
    return next(encode_batch(vocab, memory, [text], n))


def decode(vocab: dict, ids) -> str:
    """The text of piece ids."""
    table = vocab["text"]
    text = b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")
    return text.removeprefix(" ")


def _broadcast(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast({"vocab": load(path), "memory": new_memory()})


def encode_texts(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", n: int = 4, path: str = MODEL, alternatives: bool = False,
) -> DataFrame:
    """``ident``, ``ids`` of the best segmentation, ``n_pieces``, ``score``, ``nbest_scores``, ``round_trip`` (decoding gives the text).

    ``alternatives`` adds ``nbest_edits``: the other segmentations, in order of score, as edits of the best one, which replace its ids from
    ``start`` to before ``stop`` (see :func:`nbest_ids`); ``round_trip`` then says that every segmentation gives the text.
    """
    small_batches(docs.sparkSession, 250)
    held = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, memory = held.value["vocab"], held.value["memory"]
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist(), _CHARS):
                found = list(encode_batch(vocab, memory, texts, n))
                scores = [e.scores for e in found]
                fine = [decode(vocab, e.ids.tolist()) == body and (not alternatives or _same_text(vocab, e)) for body, e in zip(texts, found, strict=True)]
                out = [
                    batch.column(0).slice(at, len(texts)), _lists([e.ids for e in found]),
                    pa.array([len(e.ids) for e in found], pa.int64()),
                ]
                out += [
                    pa.array([x[0] for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(fine, pa.bool_()),
                ]
                if alternatives:
                    out.append(pa.array([e.edits() for e in found], _EDITS))
                yield pa.RecordBatch.from_arrays(
                    out, names=["id", "ids", "n_pieces", "score", "nbest_scores", "round_trip", *(["nbest_edits"] * alternatives)],
                )

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_pieces long, score double, nbest_scores array<double>, round_trip boolean"
    return rows.mapInArrow(
        run, schema + ", nbest_edits array<array<struct<start: int, stop: int, ids: array<int>>>>" * alternatives,
    ).withColumnRenamed("id", ident)


def nbest_ids(ids: str = "ids", edits: str = "nbest_edits") -> Column:
    """The piece ids of all segmentations, the best one first: an array of arrays, made of the columns of :func:`encode_texts`."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def apply(acc: Column, e: Column) -> Column:
        return F.struct(
            e["stop"].alias("at"), F.concat(acc["out"], F.slice(ids, acc["at"] + 1, e["start"] - acc["at"]), e["ids"]).alias("out"),
        )

    whole = lambda acc: F.concat(acc["out"], F.slice(ids, acc["at"] + 1, F.size(ids)))
    return F.concat(F.array(F.col(ids)), F.transform(edits, lambda es: F.aggregate(es, start, apply, whole)))


_EDITS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))


def _same_text(vocab: dict, e: Encoding) -> bool:
    """Whether all segmentations give the text of the best one: they differ in cuts only, which are compared byte by byte."""
    joined = lambda ids: b"".join([vocab["text"][i] for i in ids])
    return all(joined(ids) == joined(e.cut(c).tolist()) for other in e.others for c, ids in other.items())


def decode_ids(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """``rows`` with the text of their piece ids in the new column ``out``."""
    held = _broadcast(rows.sparkSession, path)

    @F.pandas_udf("string")
    def text_of(col: pd.Series) -> pd.Series:
        return col.map(lambda x: decode(held.value["vocab"], [] if x is None else list(x)))

    return rows.withColumn(out, text_of(F.col(ids)))

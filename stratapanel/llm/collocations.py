"""Phrase collocations from FM-indexes over word ids.

Every task cuts its documents into shards of about ``SHARD_WORDS`` words and numbers each shard's words per language; 0 marks the ends
of pieces, which no phrase crosses.  A shard's bidirectional FM-index is two Burrows-Wheeler transforms, of the sequence and of its
reverse, whose rows are sorted no deeper than the longest phrase needs.  A phrase is an interval of rows in either; the symbols in one
transform's interval, counted, are all extensions of the phrase to that side, and give the intervals of the longer phrases in both.
All intervals of a length are extended at once.  Counts are summed over the shards, partially in the tasks.

A phrase can't be frequent unless its words and pairs of words are, so there are three passes: words; pairs of frequent words, by their
hashes only; phrases whose pairs have frequent hashes.  What is frequent goes to the tasks as a bitmap of hashes of at most ``FILTER_BITS``
bits, which lets a few others through and holds back none; the last sums are by the phrases themselves, so hashes and bitmaps save work
and change no count.

Cases: null texts count as empty, a null language is ``und``; texts without a word give nothing; repeated rows count each; pieces and
texts of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Bytes at which texts are cut into pieces; words are runs of anything but spaces and tabs.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Words of a shard, about; a worker's memory goes by it.
SHARD_WORDS = 1 << 21
#: Bits of the bitmap per frequent phrase, and its largest size.
BITS_PER_KEY = 16
FILTER_BITS = 1 << 28
_PIECE = 1 << 15
_ROWS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class FmIndex:
    """A Burrows-Wheeler transform of a ring of symbols, its rows in order of their first ``depth`` symbols.

    Intervals of phrases of at most ``depth`` symbols are as in a full sort: order within equal prefixes moves none of their ends.
    """

    def __init__(self, symbols: np.ndarray, size: int, depth: int):
        self.n, self.size = len(symbols), size
        rank, top, reach = symbols.astype(np.int64), size, 1
        while reach < depth:
            kinds, rank = np.unique(rank * top + np.roll(rank, -reach), return_inverse=True)
            top, reach = len(kinds), 2 * reach
        #: the symbol in front of each row
        self.before = symbols[np.argsort(rank, kind="stable") - 1].astype(np.int64)
        order = np.argsort(self.before, kind="stable")
        #: where each symbol stands, by symbol and row: ranks are found by bisection
        self.places = self.before[order] * self.n + order
        self.starts = np.searchsorted(self.places, np.arange(size) * self.n)

    def extend(self, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Extensions of intervals that don't overlap by the symbols before their rows: which interval, symbol, count, the first row of the
        longer phrase, and how many rows of the interval have a smaller symbol."""
        ahead = np.cumsum(count) - count
        which = np.repeat(np.arange(len(low)), count)
        rows = np.arange(len(which)) + (low - ahead)[which]
        key, counts = np.unique(which * self.size + self.before[rows], return_counts=True)
        which, symbol = np.divmod(key, self.size)
        smaller = np.cumsum(counts) - counts - ahead[which]
        return which, symbol, counts, np.searchsorted(self.places, symbol * self.n + low[which]), smaller


@dataclass
class Phrases:
    """Phrases of one length: their symbols, their first row in either index, their counts."""

    words: np.ndarray
    low: np.ndarray
    low_back: np.ndarray
    count: np.ndarray


Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]


class BothWays:
    """The FM-indexes of a sequence and of its reverse, with intervals kept in step."""

    def __init__(self, symbols: np.ndarray, size: int, depth: int):
        self.of = (symbols, size, depth)

    @cached_property
    def forward(self) -> FmIndex:
        return FmIndex(*self.of)

    @cached_property
    def backward(self) -> FmIndex:
        symbols, *rest = self.of
        return FmIndex(symbols[::-1], *rest)

    def words(self) -> Phrases:
        ends = np.append(self.backward.starts, self.backward.n)
        low, count = ends[1:-1], np.diff(ends)[1:]
        held = count > 0
        return Phrases((np.flatnonzero(held) + 1)[:, None], low[held], low[held], count[held])

    def left(self, p: Phrases, allowed: Allowed) -> Phrases:
        which, symbol, count, low, smaller = self.forward.extend(p.low, p.count)
        keep = np.flatnonzero((symbol > 0) & allowed(symbol, p.words[which, 0]))
        which, symbol = which[keep], symbol[keep]
        return Phrases(np.column_stack([symbol, p.words[which]]), low[keep], p.low_back[which] + smaller[keep], count[keep])

    def right(self, p: Phrases, allowed: Allowed) -> Phrases:
        which, symbol, count, low, smaller = self.backward.extend(p.low_back, p.count)
        keep = np.flatnonzero((symbol > 0) & allowed(p.words[which, -1], symbol))
        which, symbol = which[keep], symbol[keep]
        return Phrases(np.column_stack([p.words[which], symbol]), p.low[which] + smaller[keep], low[keep], count[keep])


def enumerate_phrases(symbols: np.ndarray, size: int, longest: int, allowed: Allowed) -> Iterator[Phrases]:
    """All phrases of 2 to ``longest`` symbols other than 0 whose neighbours are all ``allowed``, grown to the right and left in turn."""
    index = BothWays(symbols, size, max(1, longest - 1))
    found = index.words()
    for k in range(2, longest + 1):
        found = (index.left if k % 2 else index.right)(found, allowed)
        if not len(found.count):
            return
        yield found


def _table() -> np.ndarray:
    """What bytes become: A-Z lower case, tabs spaces, ends of pieces line feeds."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9] = 32
    table[list(BREAKS)] = 10
    return table


_TABLE = _table()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in lower case (A-Z only), which text each is of, and whether a piece begins with it."""
    texts = pa.concat_arrays([texts])  # its own buffers, from their beginning
    ends = np.frombuffer(texts.buffers()[1], np.int32)[:len(texts) + 1].astype(np.int64)
    data = _TABLE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:ends[-1]]]
    inside = (data != 32) & (data != 10)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < ends[-1]]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    kept = data[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    text = np.searchsorted(ends, starts, "right") - 1
    breaks = np.searchsorted(np.flatnonzero(data == 10), starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(breaks) > 0) | (np.diff(text) > 0)
    return words, text, fresh


def with_breaks(symbols: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The symbols with a 0 before each at which a piece begins, and at the end."""
    at = np.arange(len(symbols)) + np.cumsum(fresh)
    out = np.zeros((at[-1] if len(at) else -1) + 2, np.int64)
    out[at] = symbols
    return out


@dataclass
class Shard:
    """Symbols of a shard's words and whether a piece begins with each; symbol i > 0 is ``words[word[i]]`` in the language ``langs[lang[i]]``."""

    symbols: np.ndarray
    fresh: np.ndarray
    words: pa.Array
    word: np.ndarray
    langs: list[str]
    lang: np.ndarray

    def hashes(self) -> np.ndarray:
        """A hash of each symbol's language and word, the same in every shard."""
        made = lambda x: pd.util.hash_array(np.asarray(x, object), categorize=False).astype(np.uint64)
        words = made(self.words.take(pa.array(self.word)).to_numpy(zero_copy_only=False))
        return joined_hash(made(self.langs)[self.lang], words)

    def kept(self, keep: np.ndarray) -> tuple[Shard, np.ndarray]:
        """The shard without the words that are not kept, each the end of a piece, and the old numbers of its symbols."""
        keep = keep.copy()
        keep[0] = True
        old, stays = np.flatnonzero(keep), keep[self.symbols]
        at = np.flatnonzero(stays)
        gone = np.diff(at, prepend=-1) > 1
        pieces = np.cumsum(self.fresh)[at]
        fresh = gone | (np.diff(pieces, prepend=0) > 0)
        return Shard((np.cumsum(keep) - 1)[self.symbols[at]], fresh, self.words, self.word[old], self.langs, self.lang[old]), old

    def runs(self, allowed: Allowed, least: int) -> np.ndarray:
        """Symbols with 0 between neighbours that aren't allowed, and without runs of fewer than ``least`` words."""
        fresh = self.fresh.copy()
        fresh[1:] |= ~allowed(self.symbols[:-1], self.symbols[1:])
        starts = np.flatnonzero(fresh)
        length = np.diff(starts, append=len(fresh))
        stays = np.repeat(length >= least, length)
        return with_breaks(self.symbols[stays], fresh[stays])

    def rows(self, symbols: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each phrase, given by the symbols in a row of ``symbols``."""
        langs = pa.array(self.langs)
        for at in range(0, len(count), _ROWS):
            part = symbols[at:at + _ROWS]
            columns = [self.words.take(pa.array(self.word[part[:, j]])) for j in range(part.shape[1])]
            phrase = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(self.lang[part[:, 0]])), phrase, pa.array(np.full(n, part.shape[1], np.int32)),
                    pa.array(hashes[at:at + _ROWS].view(np.int64)), pa.array(count[at:at + _ROWS].astype(np.int64)),
                ], names=["lang", "phrase", "size", "h", "f"],
            )


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_WORDS) -> Iterator[Shard]:
    """Shards of the (lang, text) rows of a task."""
    names: dict[str, int] = {}
    parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words, text, fresh = split_words(part.column(1))
            lang = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], np.int32)[text]
            parts.append((words, lang, fresh))
            held += len(words)
            if held >= most:
                yield _shard(*zip(*parts, strict=True), list(names))
                parts, held = [], 0
    if held:
        yield _shard(*zip(*parts, strict=True), list(names))


def _shard(words: tuple[pa.Array, ...], langs: tuple[np.ndarray, ...], fresh: tuple[np.ndarray, ...], names: list[str]) -> Shard:
    coded = pa.concat_arrays(words).dictionary_encode()
    width = max(1, len(coded.dictionary))
    kinds, symbols = np.unique(np.concatenate(langs).astype(np.int64) * width + coded.indices.to_numpy(), return_inverse=True)
    lang, word = np.divmod(np.insert(kinds, 0, 0), width)
    return Shard((symbols + 1).astype(np.int32), np.concatenate(fresh), coded.dictionary, word, names, lang)


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbours made of their hashes."""
    mixed = (a * _MIX) ^ (b + (a >> np.uint64(29)))
    return (mixed ^ (mixed >> np.uint64(32))) * _MIX


def among(held: tuple[int, bytes], hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in a bitmap, given as its number of bits and its bytes."""
    bits, bitmap = held
    place = hashes & np.uint64(bits - 1)
    byte = np.frombuffer(bitmap, np.uint8)[(place >> np.uint64(3)).astype(np.int64)]
    return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame) -> Broadcast:
    """The bitmap of ``keys`` (column ``h``), made by Spark in pieces of 4 KB; at most FILTER_BITS / 8 bytes, whatever the input."""
    bits, n = _PIECE, keys.count()
    while bits < min(FILTER_BITS, BITS_PER_KEY * n):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    pieces = keys.groupBy(F.shiftright(place, 15).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(_PIECE - 1))).alias("map"))
    whole = bytearray(bits // 8)
    for r in pieces.toLocalIterator():
        whole[r["piece"] * _PIECE // 8:(r["piece"] + 1) * _PIECE // 8] = r["map"]
    return keys.sparkSession.sparkContext.broadcast((bits, bytes(whole)))


Work = Callable[[Shard], Iterator[pa.RecordBatch]]


def _by_shards(rows: DataFrame, run: Work, shard_words: int, schema: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            yield from run(shard)

    return rows.mapInArrow(work, schema)


def _counted(rows: DataFrame, run: Work, shard_words: int) -> DataFrame:
    """Counts of the phrases that ``run`` gives for each shard, summed over all shards: lang, phrase, size, h, f."""
    found = _by_shards(rows, run, shard_words, "lang string, phrase string, size int, h long, f long")
    return found.groupBy("lang", "phrase").agg(F.any_value("size").alias("size"), F.any_value("h").alias("h"), F.sum("f").alias("f"))


def _words(shard: Shard) -> Iterator[pa.RecordBatch]:
    count, hashes = np.bincount(shard.symbols, minlength=len(shard.word))[1:], shard.hashes()[1:]
    yield from shard.rows(np.arange(1, len(count) + 1)[:, None], count, hashes)


def _pairs(frequent: Broadcast) -> Work:
    """Hashes of pairs of frequent words, with counts."""

    def run(shard: Shard) -> Iterator[pa.RecordBatch]:
        hashes = shard.hashes()
        shard, old = shard.kept(among(frequent.value, hashes))
        hashes = hashes[old]
        anything = lambda a, b: np.ones(len(a), bool)
        for p in enumerate_phrases(with_breaks(shard.symbols, shard.fresh), len(shard.word), 2, anything):
            h = joined_hash(hashes[p.words[:, 0]], hashes[p.words[:, 1]]).view(np.int64)
            for at in range(0, len(h), _ROWS):
                yield pa.RecordBatch.from_pydict({"h": h[at:at + _ROWS], "f": p.count[at:at + _ROWS]})

    return run


def _longer(words: Broadcast, pairs: Broadcast, longest: int) -> Work:
    """Phrases of two words and more whose pairs have frequent hashes."""

    def run(shard: Shard) -> Iterator[pa.RecordBatch]:
        hashes = shard.hashes()
        shard, old = shard.kept(among(words.value, hashes))
        hashes = hashes[old]
        allowed = lambda a, b: among(pairs.value, joined_hash(hashes[a], hashes[b]))
        anything = lambda a, b: np.ones(len(a), bool)
        for p in enumerate_phrases(shard.runs(allowed, 2), len(shard.word), longest, anything):
            yield from shard.rows(p.words, p.count, np.zeros(len(p.count), np.uint64))

    return run


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur at least ``least`` times (lang, phrase, size, f), and the words per language (lang, n)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = materialise(_counted(rows, _words, shard_words), "phrases-words")
    often = F.col("f") >= least
    held = key_filter(words.where(often))
    pairs = _by_shards(rows, _pairs(held), shard_words, "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).where(often)
    pairs = materialise(pairs.select("h"), "phrases-pairs")
    longer = materialise(_counted(rows, _longer(held, key_filter(pairs), longest), shard_words).where(often), "phrases")
    return words.where(often).unionByName(longer).select("lang", "phrase", "size", "f"), words.groupBy("lang").agg(F.sum("f").alias("n"))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, a, l, r, score; ``phrases`` is what :func:`phrase_counts` gives."""
    cuts = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")


def inside_longer(phrases: DataFrame, hundredths: int) -> DataFrame:
    """Phrases (lang, phrase) with an extension by one word, to the left or right, that occurs at least ``hundredths`` % as often.

    A longer phrase that contains one occurs no more often than the extensions between them, so these decide.
    """
    ends = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
    most = phrases.where("size > 2").select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = phrases.join(most, ["lang", "phrase"])
    return held.where(_wide("longer") * 100 >= _wide("f") * hundredths).select("lang", "phrase")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, hundredths: int = 80, top: int = 2000,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The first ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = phrase_counts(docs, text, lang, least, longest, shard_words)
    found = scored(phrases).join(inside_longer(phrases, hundredths), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

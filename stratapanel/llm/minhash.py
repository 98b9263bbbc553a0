"""Near-duplicate documents by DartMinHash signatures, banding and exact verification.

Signatures: the plane (weight, rank) of every element is cut into cells of area 1; a hash of (element, cell) says how many darts
fall into the cell (Poisson with mean 1) and where.  A set throws the darts of its elements that lie below their weights and
below the rank t / (total weight), t = k ln k + 2 k, about t darts whatever the size of the set.  A dart's hash names its
coordinate; each coordinate keeps its earliest dart.  Two sets agree in a coordinate with a probability equal to their weighted
Jaccard similarity.  Where a coordinate stays empty, the set throws over twice the rank.

Search: documents with equal sets of shingles are one class.  Bands of the signature put classes in buckets.  In a bucket not
all pairs are compared: in each round every bucket names a leader, first its most central member, and members of other
components are compared with the leader by the exact Jaccard similarity of their shingle sets; links found merge components.
Only pairs that lie in one bucket and still in different components can add a link, so the rounds go on until the pairs left
are no burden, and then all of these are taken.  Before the exact comparison, pairs are weighed inside the join by one bit of
many coordinates, a few 64-bit words: a pair goes on unless its bits are so far off as those of one link in a billion.

Cases: texts with fewer than five words have one shingle, all their words; null and empty texts have none, are no copies of
anything and stay; repeated rows (same id, same text) are one document; different texts with one id, or with none, are
different documents, of which a group keeps one; null ids are grouped but never stay where another id is present; an empty
table gives an empty result; other columns, whatever their names, pass through :func:`deduplicate` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, connected_components, drop_table, likely_among, materialise, small_batches, surviving, text_of
from .textvec import chunks, mix64, words

SHINGLE = 5
LEAST = 0.8
#: BANDS bands of ROWS coordinates: a pair right at the threshold shares no bucket with a probability of 4.6 in 10,000,000.
BANDS, ROWS = 62, 7
#: The bits of a pair right at the threshold are taken for those of no link with at most this probability.
MISS = 1e-9
#: Texts are sketched so many at a time: a text throws some thousands of darts, however short it is.
_CHARS, _TEXTS = 400_000, 128
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_PRIMES = [np.uint64(p) for p in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, hash, count), sorted by both."""
    h, per = words(texts)
    first = np.cumsum(per) - per
    n = np.where(per > 0, np.maximum(per - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(per, size)[owner]
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = j < width
        out[inside] = mix64(out[inside] * _PRIMES[1] + h[at[inside] + j])
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    place = np.flatnonzero(new)
    return owner[place], out[place], np.diff(np.append(place, len(out)))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """DartMinHash: a (sets x k) array of dart hashes from rows (set, element, weight > 0).  Sets without elements keep zeros."""
    best = np.full(sets * k, np.inf)
    sig = np.zeros(sets * k, np.uint64)
    total = np.bincount(owner, weight, minlength=sets)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    active = total > 0
    while active.any():
        mine = active[owner]
        own, elem, w, top = owner[mine], element[mine], weight[mine], limit[owner[mine]]
        octave = 0
        while len(own):
            # weights (0, 1], then (1, 2], (2, 4], ...; a cell is as high in rank as makes its area 1
            low, high = (0.0, 1.0) if octave == 0 else (2.0 ** (octave - 1), 2.0**octave)
            tall = 1.0 / (high - low)
            cells = np.ceil(top / tall).astype(np.int64)
            which = np.repeat(np.arange(len(own)), cells)
            slice_ = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
            cell = mix64(elem[which] + slice_.astype(np.uint64) * _PRIMES[0] + np.array([octave], np.uint64) * _PRIMES[2])
            darts = np.searchsorted(_POISSON, _unit(cell))
            from_ = np.repeat(np.arange(len(which)), darts)
            number = np.arange(len(from_)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix64(cell[from_] + (number + 1).astype(np.uint64) * _PRIMES[3])
            rank = (slice_[from_] + _unit(mix64(dart ^ _PRIMES[1]))) * tall
            src = which[from_]
            hit = rank < top[src]
            if octave or (w < 1.0).any():
                hit &= low + (high - low) * _unit(mix64(dart ^ _PRIMES[2])) <= w[src]
            dart, rank, spot = dart[hit], rank[hit], own[src[hit]] * k + (dart[hit] % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, spot, rank)
            first = rank == best[spot]
            sig[spot[first]] = dart[first]
            more = w > high
            own, elem, w, top = own[more], elem[more], w[more], top[more]
            octave += 1
        empty = np.isinf(best.reshape(sets, k)).any(axis=1)
        active &= empty
        limit = np.where(active, limit * 2.0, limit)
    return sig.reshape(sets, k)


def _weighed(k: int) -> int:
    """Of k coordinates so many give a bit: whole words, where there is one."""
    return k if k < 64 else k // 64 * 64


def _sketches(bands: int, rows: int, weighted: bool):
    k = bands * rows
    weighed = _weighed(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"]
            for at, texts in chunks(batch["text"], _CHARS, _TEXTS):
                owner, shingle, count = shingle_sets(texts)
                weight = count.astype(float) if weighted else np.ones(len(count))
                n = np.bincount(owner, minlength=len(texts))
                value = mix64(shingle ^ count.astype(np.uint64)) if weighted else shingle
                prints = []
                for salt in _PRIMES[:2]:
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(value ^ salt))])
                    ends = np.cumsum(n)
                    prints.append((sums[ends] - sums[ends - n]).view(np.int64))
                sig = dart_signatures(owner, shingle, weight, len(texts), k).reshape(len(texts), bands, rows)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(texts), bands)).copy()
                for j in range(rows):
                    band = mix64(band * _PRIMES[0] + sig[:, :, j])
                flat = (mix64(sig.reshape(len(texts), k)[:, :weighed]) >> np.uint64(63)).astype(np.uint8)
                flat = np.pad(flat, ((0, 0), (0, -weighed % 64)))
                bits = np.packbits(flat, axis=1).view(np.int64)
                part = slice(at, at + len(texts))
                yield pd.DataFrame(
                    {
                        "id": ids.iloc[part].to_numpy(), "sha": batch["sha"].iloc[part].to_numpy(), "n": n, "fp1": prints[0],
                        "fp2": prints[1], "bands": list(band.view(np.int64)), "bits": list(bits),
                    }
                )

    return run


def _sets(weighted: bool):
    """Shingle sets; ``weighted`` ones have an element for every occurrence, so that their Jaccard similarity is the weighted one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, texts in chunks(batch["text"], _CHARS):
                owner, shingle, count = shingle_sets(texts)
                if weighted:
                    owner, shingle = np.repeat(owner, count), np.repeat(shingle, count)
                    turn = np.arange(len(shingle)) - np.repeat(np.cumsum(count) - count, count)
                    shingle = np.where(turn > 0, mix64(shingle + turn.astype(np.uint64) * _PRIMES[0]), shingle)
                parts = np.split(shingle.view(np.int64), np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
                yield pd.DataFrame({"id": batch["node"].iloc[at : at + len(texts)].to_numpy(), "s": parts})

    return run


def sketch(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, weighted: bool = False,
) -> DataFrame:
    """``id``, the SHA-256 of the text ``sha``, number of shingles ``n``, a 128-bit print of the shingle set (``fp1``, ``fp2``), the band hashes
    ``bands``, and one bit of each weighed coordinate in the words ``bits``.

    ``weighted`` counts repeated shingles as weights instead of once.
    """
    small_batches(docs.sparkSession)
    rows_ = docs.select(F.col(ident).alias("id"), F.sha2(text_of(text), 256).alias("sha"), text_of(text).alias("text"))
    kind = rows_.schema["id"].dataType.simpleString()
    return rows_.mapInPandas(
        _sketches(bands, rows, weighted), f"id {kind}, sha string, n long, fp1 long, fp2 long, bands array<long>, bits array<long>",
    )


def _similar(s: str, t: str, least: float) -> F.Column:
    """Whether two shingle sets have a Jaccard similarity of at least ``least``; sizes too far apart are not intersected."""
    n, m = F.size(s), F.size(t)
    both = F.size(F.array_intersect(s, t))
    return (F.least(n, m) >= F.lit(least) * F.greatest(n, m)) & (both >= F.lit(least) * (n + m - both))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets are similar."""
    a = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(_similar("sa", "sb", least)).select("a", "b")


def _most_off(k: int, least: float, miss: float = MISS) -> int:
    """The fewest differing bits that a link has no more than, but for a probability of ``miss`` (exact binomial tail)."""
    q, tail = (1 - least) / 2, 0.0
    for m in range(k, 0, -1):
        tail += math.comb(k, m) * q**m * (1 - q) ** (k - m)
        if tail > miss:
            return m
    return 0


def _likely(words: int, k: int, least: float) -> F.Column:
    """Whether the bits ``x0 ..`` and ``y0 ..`` may be those of a link: each agrees with a probability of (1 + similarity) / 2."""
    most = _most_off(k, least)
    off = sum(
        (F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, words)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))),
    )
    return off <= most


#: Rows of a tile: a bucket of more than two of these is split into pairs of tiles for the last round.
TILE = 256


def _block(least: float):
    """Links between two tiles of a bucket (or within one), by exact sizes of intersections: products of incidence matrices, some shingles at a time."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        sizes = rows["s"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(rows)), sizes)
        kinds, code, count = np.unique(np.concatenate(rows["s"].tolist()) if len(rows) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        shared = count > 1  # others are in no intersection
        held = shared[code]
        owner, code = owner[held], (np.cumsum(shared) - 1)[code[held]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        tile = rows["tile"].to_numpy()
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        both = np.zeros((len(left), len(right)), np.float32)
        step = max(1, (1 << 23) // max(1, len(rows)))
        for at in range(0, int(shared.sum()), step):
            part = slice(*np.searchsorted(code, [at, at + step]))
            m = np.zeros((len(rows), step), np.float32)
            m[owner[part], code[part] - at] = 1.0
            both += m[left] @ m[right].T
        n, ids, comps = sizes, rows["id"].to_numpy(), rows["comp"].to_numpy()
        link = both >= least * (n[left][:, None] + n[right][None, :] - both.astype(np.float64))
        link &= comps[left][:, None] != comps[right][None, :]
        if lo == hi:
            link &= ids[left][:, None] < ids[right][None, :]
        i, j = np.nonzero(link)
        a, b = ids[left[i]], ids[right[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _tiled(state: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """All links of the buckets in ``state`` (key, id, comp, m), each bucket dealt to pairs of tiles; a task holds two tiles, whatever the bucket."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    rows = state.select("key", "id", "comp", F.pmod(F.xxhash64("id"), tiles).cast("int").alias("tile"), tiles.alias("tiles"))
    rows = rows.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "id", "comp", "tile", "s")
    return rows.groupBy("key", "lo", "hi").applyInPandas(_block(least), "a long, b long")


def near_groups(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST, bands: int = BANDS, rows: int = ROWS,
    spare: int = 2000, rounds: int = 8, weighted: bool = False,
) -> DataFrame:
    """One row per document: the id, ``class_id`` (smallest id with the same shingle set), ``group_id`` (smallest id of its
    component of links), ``kept`` (id = group_id, and of different texts with that id the one with the smallest SHA-256).

    Leader rounds stop after ``rounds``, or when fewer than ``spare`` pairs per bucket member are open; then all open pairs are
    weighed, so that both are no bounds on what is found; buckets of many rows are split into pairs of tiles for that.  ``weighted`` counts a shingle as often as it occurs, in the signatures and in
    the comparison: the similarity is then the sum of the lesser counts over the sum of the greater ones.
    """
    found = _grouped(docs, ident, text, least, bands, rows, spare, rounds, weighted)
    return found.select(F.col("id").alias(ident), "class_id", "group_id", "kept")


def _grouped(
    docs: DataFrame, ident: str, text: str, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, spare: int = 2000, rounds: int = 8,
    weighted: bool = False,
) -> DataFrame:
    """``id, sha, class_id, group_id, kept, copies`` of every row; ``copies`` have its shingles.  Classes go by the number of one of their rows, as ids may repeat or be null."""
    weighed = _weighed(bands * rows)
    words = -(-weighed // 64)
    x, y = [f"x{i}" for i in range(words)], [f"y{i}" for i in range(words)]
    likely = _likely(words, weighed, least)
    made = materialise(sketch(docs, ident, text, bands, rows, weighted).withColumn("row", F.monotonically_increasing_id()), "dart-sketches")
    stays = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("stays")
    classes = materialise(
        made.where("n > 0").groupBy("fp1", "fp2").agg(F.min("row").alias("rep"), stays, F.count("*").alias("copies")), "dart-classes",
    )
    one = made.where("n > 0").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    one = one.select(F.col("row").alias("id"), "sha", "bands", *[F.col("bits")[i].alias(x[i]) for i in range(words)])
    placed = one.select("id", F.explode("bands").alias("key"), *x)
    filled = placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    mates = materialise(placed.join(filled, "key"), "dart-buckets")
    central = mates.groupBy("id").agg(F.sum("m").alias("central"))
    lead = mates.join(central, "id").groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("neg"), *x)).alias("top"))
    lead = lead.select("key", (-F.col("top.neg")).alias("lead"), *[F.col(f"top.{c}").alias(d) for c, d in zip(x, y, strict=True)])
    pair = [F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")]
    tried = materialise(
        mates.join(lead, (mates["key"] == lead["key"]) & (F.col("id") != F.col("lead")) & likely).select(*pair).distinct(), "dart-pairs",
    )
    need = one.select(F.col("id").alias("node"), "sha").join(mates.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    need = materialise(need, "dart-need")
    texts = docs.select(F.sha2(text_of(text), 256).alias("sha"), text_of(text).alias("text"))
    # copies of a text fold in the map tasks, before the join
    texts = likely_among(texts, need.select("sha"), "sha").dropDuplicates(["sha"])
    sets = materialise(texts.join(need, "sha").mapInPandas(_sets(weighted), "id long, s array<long>"), "dart-sets")
    links = materialise(_verified(tried, sets, least), "dart-links")
    for number in range(rounds + 1):
        comps = connected_components(links, "a", "b")
        state = mates.drop("m").join(comps, F.col("id") == F.col("node"), "left").select(
            "key", "id", F.coalesce("component", "id").alias("comp"), *x,
        )
        held = state.groupBy("key", "comp").agg(F.count("*").alias("c"))
        mixed = held.groupBy("key").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.max(F.struct("c", "comp")).alias("main"),
        ).where("m * m > q")
        state = materialise(state.join(mixed.select("key", "m", "q", F.col("main.comp").alias("main")), "key"), "dart-open")
        # each of the m rows of a bucket stands for its share of the bucket's open pairs
        left = state.agg(F.count("*"), F.sum((F.col("m") * F.col("m") - F.col("q")) / (2 * F.col("m")))).head()
        if not left[0]:
            break
        last = number == rounds or left[1] <= spare * left[0]
        if last:
            # the sets travel with the rows, so that the join itself gives links only, however many pairs are close to one
            left_ = state.where(F.col("m") <= 2 * TILE).select("key", "id", "comp", *x).join(sets, "id")
            right = left_.select(
                F.col("key").alias("k2"), F.col("id").alias("lead"), F.col("comp").alias("at"), F.col("s").alias("s2"),
                *[F.col(c).alias(d) for c, d in zip(x, y, strict=True)],
            )
            met = (F.col("key") == F.col("k2")) & (F.col("id") < F.col("lead")) & (F.col("comp") != F.col("at")) & likely & _similar("s", "s2", least)
            more = left_.join(right, met).select(*pair)
            if state.where(F.col("m") > 2 * TILE).head(1):
                more = more.unionByName(_tiled(state.where(F.col("m") > 2 * TILE), sets, least))
            more = materialise(more.distinct(), "dart-links")
        else:
            turn = F.struct(F.xxhash64("id", "key", F.lit(number)).alias("turn"), "id", "comp", *x)
            other = state.where("comp != main").groupBy("key").agg(F.min(turn).alias("p"))
            other = other.select(
                "key", F.col("p.id").alias("lead"), F.col("p.comp").alias("at"),
                *[F.col(f"p.{c}").alias(d) for c, d in zip(x, y, strict=True)],
            )
            met = (state["key"] == other["key"]) & (F.col("comp") != F.col("at")) & likely
            fresh = materialise(state.join(other, met).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "dart-pairs")
            more = materialise(_verified(fresh, sets, least), "dart-links")
            tried = materialise(tried.unionByName(fresh), "dart-pairs")
        links = materialise(links.unionByName(more), "dart-links")
        drop_table(state)
        if last:
            comps = connected_components(links, "a", "b")
            break
    groups = classes.join(comps, F.col("rep") == F.col("node"), "left")
    groups = materialise(groups.select("fp1", "fp2", "copies", "stays", F.coalesce("component", "rep").alias("group")), "dart-groups")
    heads = materialise(groups.groupBy("group").agg(F.min("stays").alias("head"), F.count("*").alias("n")), "dart-heads")
    keyed = attach_groups(groups, heads, "group", "n").select(F.struct("fp1", "fp2").alias("fp"), "copies", "stays", "head")
    rows_ = made.where("n > 0").select("id", "sha", F.struct("fp1", "fp2").alias("fp"))
    kept = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("sha") == F.col("head.sha"))
    found = attach_groups(rows_, materialise(keyed, "dart-groups"), "fp", "copies")
    found = found.select("id", "sha", F.col("stays.id").alias("class_id"), F.col("head.id").alias("group_id"), kept.alias("kept"), "copies")
    none = made.where("n = 0").select(
        "id", "sha", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(True).alias("kept"),
        F.lit(1).cast("long").alias("copies"),
    )
    return found.unionByName(none)


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document, that with the smallest id, of each group of near copies.  A row is told by its id and text."""
    return surviving(docs, ident, text, _grouped(docs, ident, text).select("id", "sha", "kept", "copies"))

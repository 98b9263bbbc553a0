"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors, cosine >= c is the same as a distance of at most eps = sqrt(2 - 2 c).

1. Equal vectors are folded into one class (partial aggregation), so copies are never paired with each other.
2. The leading principal directions come from a few rounds of subspace iteration; each round sums one short array per component.
3. Unit vectors are projected; (projection, norm of the rest) keeps cosines as an upper bound.  Rows are sorted by grid cell of
   side eps over the leading dimensions into bands (range partitions), and cut into segments, short intervals of that order.
4. Boxes of bands are joined by grid cell; pairs of bands farther apart than eps are skipped.  A pair of bands is one task, and
   only those segments are sent to it whose boxes come within eps of the other band, which loses nothing.  A vector is thus
   sent once per neighbouring band, not once per neighbouring segment.
5. A task joins its two sequences by halving both intervals, again skipping distant boxes, down to blocks that are compared by
   a matrix product in double precision.
6. It returns link counts and a spanning forest, never the pairs, so a dense cluster costs rows in proportion to its vectors.

Boxes prune where vectors lie in clusters.  Vectors spread evenly in many dimensions are all near each other in any few of them;
then all bands are joined, n / (vectors per band) times the input is sent, and products of all blocks are taken.

Cases: null or empty vectors, zero vectors, and vectors with null or non-finite components link with nothing; shorter vectors are
padded with zeros to the longest length; repeated rows (same id and vector) count as further vectors that are linked; null ids
are given back as they are and link with nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegralType

from .common import attach_groups, connected_components, materialise, small_batches

LEADING = 8
SEGMENT = 512
BLOCK = 256
#: A band holds at most so many bytes of vectors in double precision; small inputs are cut into FEWEST bands all the same.
BAND_BYTES = 16 << 20
FEWEST, SMALL = 3, 4096
_ROUNDS = 1
_SLACK = 1e-9


def _usable(vec: str) -> F.Column:
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(col), width))
    for i, v in enumerate(col):
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, width: int, leading: int = LEADING) -> np.ndarray:
    """About the leading eigenvectors of the second moments of the unit vectors: a width x leading array with orthonormal columns.

    Any such axes give right results, good ones skip more.  A round sends the driver ``width`` arrays of ``leading`` numbers.
    """
    k = min(leading, width)
    axes = np.linalg.qr(np.random.default_rng(7).standard_normal((width, k)))[0]
    for _ in range(_ROUNDS):

        def products(batches: Iterator[pd.DataFrame], axes: np.ndarray = axes) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, k))
            for batch in batches:
                if len(batch):
                    u = _unit(_matrix(batch["vec"], width))
                    total += u.T @ (u @ axes)
            yield pd.DataFrame({"i": np.arange(width)} | {f"s{j}": total[:, j] for j in range(k)})

        made = vectors.select("vec").mapInPandas(products, "i long, " + ", ".join(f"s{j} double" for j in range(k)))
        sums = made.groupBy("i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toPandas()
        axes = np.linalg.qr(sums.sort_values("i").drop(columns="i").to_numpy() + 1e-12 * axes)[0]
    return axes


def _projected(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    p = u @ axes
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


def _cutter(width: int, axes: np.ndarray, segment: int, kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cut(rows: pd.DataFrame, seq: int) -> dict:
        x = _matrix(rows["vec"], width)
        p = _projected(_unit(x), axes)
        out = {"seq": seq, "ids": rows["rep"].to_numpy(), "copies": rows["n"].to_numpy(), "raw": x.astype(kind).tobytes()}
        return out | {f"lo{k}": p[:, k].min() for k in range(p.shape[1])} | {f"hi{k}": p[:, k].max() for k in range(p.shape[1])}

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seq = pd.DataFrame({"rep": [], "n": [], "vec": []}), 0
        for batch in batches:
            held = pd.concat([held, batch[["rep", "n", "vec"]]], ignore_index=True) if len(held) else batch[["rep", "n", "vec"]]
            while len(held) >= segment:
                yield pd.DataFrame([cut(held[:segment], seq)])
                held, seq = held[segment:], seq + 1
        if len(held):
            yield pd.DataFrame([cut(held, seq)])

    return segments


class _Tree:
    """Boxes over halves of an interval of the order, down to blocks."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray) -> None:
        self.unit, self.p, self.boxes = unit, _projected(unit, axes), {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            part = self.p[lo:hi]
            self.boxes[lo, hi] = part.min(axis=0), part.max(axis=0)
        return self.boxes[lo, hi]


def _halves(lo: int, hi: int) -> list[tuple[int, int]]:
    if hi - lo <= BLOCK:
        return [(lo, hi)]
    mid = (lo + hi) // 2
    return [(lo, mid), (mid, hi)]


def _block_pairs(a: _Tree, b: _Tree, same: bool, eps: float) -> Iterator[tuple[int, int, int, int]]:
    todo = [(0, len(a.unit), 0, len(b.unit))]
    while todo:
        i, j, k, m = todo.pop()
        (alo, ahi), (blo, bhi) = a.box(i, j), b.box(k, m)
        gap = np.maximum(0.0, np.maximum(alo - bhi, blo - ahi))
        if gap @ gap > eps * eps + _SLACK:
            continue
        if j - i <= BLOCK and m - k <= BLOCK:
            yield i, j, k, m
        else:
            todo += [(*x, *y) for x in _halves(i, j) for y in _halves(k, m) if not same or y[0] >= x[0]]


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _joiner(width: int, axes: np.ndarray, least: float, kind: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * least))

    def side(rows: pd.DataFrame) -> tuple[_Tree, np.ndarray, np.ndarray]:
        rows = rows.sort_values("seg")
        raw = np.concatenate([np.frombuffer(x, kind) for x in rows["raw"]]).reshape(-1, width).astype(float)
        return _Tree(_unit(raw), axes), np.concatenate(rows["ids"].tolist()), np.concatenate(rows["copies"].tolist())

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = rows["a"].iloc[0], rows["b"].iloc[0]
        same = first == second
        mine, other = rows[rows["band"] == first], rows[rows["band"] == second]
        if not len(mine) or not len(other):
            return pd.DataFrame({"id": [], "links": [], "other": []}).astype(int)
        a, ids, copies = side(mine)
        b, na, nb = a, len(a.unit), 0
        if not same:
            b, more_ids, more_copies = side(other)
            nb, ids, copies = len(b.unit), np.concatenate([ids, more_ids]), np.concatenate([copies, more_copies])
        shift = 0 if same else na
        links, root = np.zeros(na + nb, np.int64), np.arange(na + nb)
        for i, j, k, m in _block_pairs(a, b, same, eps):
            hit = a.unit[i:j] @ b.unit[k:m].T >= least
            if same and i == k:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[i:j] += hit @ copies[k + shift : m + shift]
            if not (same and i == k):
                links[k + shift : m + shift] += copies[i:j] @ hit
            labels_a, labels_b = root[i:j], root[k + shift : m + shift]
            x, y = np.nonzero(hit)
            news = np.unique(labels_a[x] * np.int64(na + nb) + labels_b[y])
            for key in news[(news // (na + nb)) != (news % (na + nb))]:
                p, q = _find(root, key // (na + nb)), _find(root, key % (na + nb))
                if p != q:
                    root[max(p, q)] = min(p, q)
            while (root != root[root]).any():
                root = root[root]
        some = links > 0
        tied = np.flatnonzero(root != np.arange(na + nb))
        return pd.DataFrame(
            {
                "id": np.concatenate([ids[some], ids[tied]]), "links": np.concatenate([links[some], np.zeros(len(tied), np.int64)]),
                "other": np.concatenate([ids[some], ids[root[tied]]]),
            }
        )

    return pair


def _near(dims: int, eps: float) -> F.Column:
    gap = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"bhi{k}"), F.col(f"blo{k}") - F.col(f"hi{k}")), 2) for k in range(dims)),
        F.lit(0.0),
    )
    return gap <= eps * eps + _SLACK


def _cells(lo: str, hi: str, eps: float, wide: int) -> F.Column:
    cell = lambda c: F.floor(F.col(c) / eps)
    return F.sequence(cell(lo) - wide, cell(hi) + wide)


def _other(boxes: DataFrame, dims: int, key: str, name: str) -> DataFrame:
    return boxes.select(
        F.col(key).alias(name), *[F.col(f"lo{k}").alias(f"blo{k}") for k in range(dims)],
        *[F.col(f"hi{k}").alias(f"bhi{k}") for k in range(dims)],
    )


def _banded(cut: DataFrame, bands: int) -> DataFrame:
    """Segments (part, seq, ...) with their place ``seg`` in the whole order, cut into ``bands`` equal runs, however many parts Spark dealt them to.

    Places are running counts over the parts, one row per part.
    """
    parts = cut.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy())
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), total.alias("total"))
    placed = cut.join(F.broadcast(parts), "part").withColumn("seg", F.col("before") + F.col("seq"))
    return placed.withColumn("band", F.floor(F.col("seg") * bands / F.col("total")).cast("int")).drop("part", "seq", "before", "total")


def band_pairs(bands: DataFrame, dims: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of bands whose boxes are within eps, found by grid cell of the first two directions."""
    right = _other(bands, dims, "band", "b")
    left = bands.withColumn("a", F.col("band"))
    left = left.withColumn("c0", F.explode(_cells("lo0", "hi0", eps, 0))).withColumn("c1", F.explode(_cells("lo1", "hi1", eps, 0)))
    right = right.withColumn("c0", F.explode(_cells("blo0", "bhi0", eps, 1))).withColumn("c1", F.explode(_cells("blo1", "bhi1", eps, 1)))
    joined = left.join(right, ["c0", "c1"])
    return joined.where((F.col("a") <= F.col("b")) & _near(dims, eps)).select("a", "b").distinct()


def needed_segments(boxes: DataFrame, bands: DataFrame, pairs: DataFrame, dims: int, eps: float) -> DataFrame:
    """``a, b, seg``: the segments of either band of a pair that come within eps of the other band's box."""
    both = pairs.select("a", "b", F.col("a").alias("band"), F.col("b").alias("far")).unionByName(
        pairs.where("a < b").select("a", "b", F.col("b").alias("band"), F.col("a").alias("far"))
    )
    far = _other(bands, dims, "band", "far")
    return both.join(boxes, "band").join(far, "far").where(_near(dims, eps)).select("a", "b", "seg")


def near_duplicates(
    rows: DataFrame, ident: str = "vec_id", vec: str = "embedding", least: float = 0.9, leading: int = LEADING, segment: int = SEGMENT,
    bands: int = 1,
) -> DataFrame:
    """One row per vector: the id, ``n_links`` (other vectors with cosine >= ``least``), ``component_id``, ``kept``.  ``bands``: at least so many."""
    if not isinstance(rows.schema[ident].dataType, IntegralType):
        raise TypeError(f"{ident} must be of an integral type; number other ids first and join the numbers back")
    small_batches(rows.sparkSession, 5000)
    good = _usable(vec) & F.col(ident).isNotNull()
    single = isinstance(rows.schema[vec].dataType, ArrayType) and isinstance(rows.schema[vec].dataType.elementType, FloatType)
    of, kind = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    slim = rows.select(
        F.col(ident).alias("id"), F.when(good, F.xxhash64(F.col(vec).cast(of))).alias("h"), F.when(good, F.col(vec).cast(of)).alias("vec"),
    )
    classes = materialise(
        slim.where("vec is not null").groupBy("vec").agg(
            F.min("id").alias("rep"), F.count("*").alias("n"),
        ).withColumn("h", F.xxhash64("vec")),
        "ego-classes",
    )
    whole = rows.select(F.col(ident).alias("id"))
    width = classes.agg(F.max(F.size("vec"))).head()[0]
    if width is None:
        return whole.select(
            F.col("id").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    eps = math.sqrt(max(1e-6, 2.0 - 2.0 * least))
    axes = principal_directions(classes, width, max(2, leading))
    dims = axes.shape[1] + 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = _projected(_unit(_matrix(batch["vec"], width)), axes)
                yield batch.assign(cell=list(np.floor(p[:, :-1] / eps).astype(int)), proj=list(p))

    count = classes.count()
    least_bands = max(bands, math.ceil(count * width * 8 / BAND_BYTES), FEWEST if count > SMALL else 1, math.ceil(count / (segment * 128)))
    placed = classes.select("rep", "n", "vec").mapInPandas(place, f"rep long, n long, vec {of}, cell array<int>, proj array<double>")
    ordered = placed.repartitionByRange(least_bands, "cell", "proj", "rep").sortWithinPartitions("cell", "proj", "rep")
    spans = ", ".join(f"{s}{k} double" for s in ("lo", "hi") for k in range(dims))
    cut = ordered.mapInPandas(_cutter(width, axes, segment, kind), f"seq int, ids array<long>, copies array<long>, raw binary, {spans}")
    cut = materialise(cut.withColumn("part", F.spark_partition_id()), "ego-segments")
    cut = _banded(cut, least_bands)
    boxes = cut.drop("ids", "copies", "raw")
    bands = boxes.groupBy("band").agg(
        *[F.min(f"lo{k}").alias(f"lo{k}") for k in range(dims)], *[F.max(f"hi{k}").alias(f"hi{k}") for k in range(dims)],
    )
    bands = materialise(bands, "ego-bands")
    pairs = materialise(band_pairs(bands, dims, eps), "ego-pairs")
    need = needed_segments(boxes, bands, pairs, dims, eps)
    found_pairs = pairs.count()
    tasks = max(1, min(4 * found_pairs, 2000), found_pairs // 4)
    sent = cut.select("seg", "band", "ids", "copies", "raw").join(need, "seg").repartition(tasks, "a", "b")
    found = sent.groupBy("a", "b").applyInPandas(_joiner(width, axes, least, kind), "id long, links long, other long")
    found = materialise(found, "ego-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "id", "other")
    state = classes.select("h", "vec", "rep", "n").join(links, F.col("rep") == links["id"], "left").drop("id").join(
        comps, F.col("rep") == comps["node"], "left",
    )
    state = state.select(
        "h", "vec", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    state = materialise(state, "ego-state")
    # a class is found by the hash of its vector; classes that share a hash, should there be any, also by the vector itself
    alone = materialise(
        state.groupBy("h").agg(
            F.count("*").alias("classes"), F.sum("n").alias("n"), F.max("n_links").alias("n_links"),
            F.max("component_id").alias("component_id"),
        ),
        "ego-hashes",
    )
    keys = slim.select("id", "h")
    out = attach_groups(keys, alone.where("classes = 1").drop("classes"), "h", "n").select("id", "n_links", "component_id")
    if alone.where("classes > 1").head(1):
        clash = slim.join(alone.where("classes > 1").select("h"), "h", "left_semi")
        out = out.unionByName(clash.join(state, ["h", "vec"]).select("id", "n_links", "component_id"))
    lone = keys.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    out = out.unionByName(lone)
    return out.select(F.col("id").alias(ident), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

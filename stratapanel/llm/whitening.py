"""Whitening of embeddings by the leading principal components, found by FEAST.

Vectors become integers, x = floor(256 c).  Each distinct x is written once; sums, and then products of centred vectors, are added up in
the tasks and by rounds of grouping, so no task and not the driver holds more than a few matrices of d x d numbers, whatever the number of
vectors.

The eigenproblem of the d x d covariance V is solved by contour integration.  Inertia counts (signs of the pivots of a factorisation of
V - s I, in tridiagonal form) tell how many eigenvalues lie above s; bisection with them finds intervals that hold one eigenvalue or some close
ones each, from the top, with a gap around.  For each interval the integral of the resolvent along a circle around it, by quadrature over
complex shifts, projects a block of vectors onto the eigenvectors inside; Rayleigh-Ritz extracts them; this is repeated with the found block
until the residuals are at rounding level.  The interval's count says whether any was missed; if so the block grows.

Cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; so are vectors of another length than most have
(of lengths as frequent, the largest counts); 256 c beyond a long counts as the nearest long; components without variance don't exist, so
equal vectors only, or a single one, give an empty result, as an empty table does; repeated rows are fitted once and returned each; null
ids stay null; a deviation beyond a long is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

SCALE = 256.0
#: Quadrature nodes on the half circle; gap below which eigenvalues share an interval, as a share of the larger; partial sums that one task adds up.
NODES = 12
GAP = 1e-3
FAN_IN = 64
#: Eigenvalues below this share of the trace are taken for 0.
TINY = 1e-13


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``, by Householder reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = u @ u
        if size > 0:
            rest = a[k + 1:, k + 1:]
            p = rest @ u * (2 / size)
            p -= u * (p @ u / size)
            rest -= np.outer(u, p) + np.outer(p, u)
            a[k + 1:, k] -= u * (2 * (u @ a[k + 1:, k]) / size)
    return a.diagonal().copy(), a.diagonal(-1).copy() ** 2


def count_above(form: tuple[np.ndarray, np.ndarray], at: float) -> int:
    """Eigenvalues above ``at``: the positive pivots of the factorisation of the shifted tridiagonal matrix."""
    diagonal, square = form
    least = np.finfo(float).tiny
    pivot, positive = 1.0, 0
    for x, y in zip(diagonal.tolist(), [0.0, *square.tolist()], strict=True):
        pivot = (x - at) - y / pivot
        if abs(pivot) < least:
            pivot = -least
        positive += pivot > 0
    return positive


def located(form: tuple[np.ndarray, np.ndarray], i: int, low: float, high: float) -> float:
    """The i-th largest eigenvalue, which lies between ``low`` and ``high``, to a small part of the gap that counts."""
    while high - low > GAP / 16 * max(abs(high), abs(low)) and low < (at := (low + high) / 2) < high:
        low, high = (at, high) if count_above(form, at) >= i else (low, at)
    return (low + high) / 2


def intervals(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """Intervals from the top (low, high, eigenvalues inside by inertia) that together hold the ``most`` largest eigenvalues, or more if some are close."""
    form, d, trace = tridiagonal(v), len(v), float(np.trace(v))
    bound = float(np.abs(v).sum(0).max()) * 1.01
    find = lambda i, high: located(form, i, TINY * trace / 2, high)
    total = count_above(form, TINY * trace)
    out, i, above, first = [], 0, np.inf, find(1, bound)
    while i < min(most, total):
        last, j, below = first, i + 1, 0.0
        while j < total:
            below = find(j + 1, last * (1 + GAP))
            if last - below > GAP * first:
                break
            last, j, below = below, j + 1, 0.0
        pad = min(above - first, last - below) / 2
        inside = count_above(form, last - pad) - count_above(form, first + pad)
        out.append((last - pad, first + pad, inside))
        i, above, first = j, last, below
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``v`` in [low, high], falling, and their unit eigenvectors as columns."""
    d = len(v)
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi * (x + 1) / 2)  # the upper half circle; the lower one gives the conjugate
    scale, rng = np.abs(v).sum(0).max(), np.random.default_rng(7)
    size = min(d, max(count + 4, 2 * count))
    block, best = rng.standard_normal((d, size)), np.inf
    for _ in range(rounds):
        projected = np.zeros((d, size))
        for z, weight in zip(turn, w, strict=True):
            projected += (weight / 2 * radius * z * np.linalg.solve((centre + radius * z) * np.eye(d) - v, block)).real
        q = np.linalg.qr(projected)[0]
        values, small = np.linalg.eigh(q.T @ v @ q)
        ritz = q @ small
        inside = np.argsort(-values)
        inside = inside[(values[inside] >= low) & (values[inside] <= high)]
        residual = np.linalg.norm(v @ ritz[:, inside] - ritz[:, inside] * values[inside], axis=0).max(initial=0.0)
        if len(inside) == count and (residual <= 1e-14 * scale or residual >= 0.5 * best and residual <= 1e-12 * scale):
            return values[inside], ritz[:, inside]
        if len(inside) == count:
            best = min(best, residual)
        if len(inside) >= count and size == d or residual > 1e3 * best:
            best = np.inf
        block = ritz
        if len(inside) != count and size < d:  # an eigenvalue is missing: a larger block
            block = np.hstack([block, rng.standard_normal((d, min(d, 2 * size) - size))])
            size = block.shape[1]
    raise RuntimeError(f"{len(inside)} of {count} eigenvalues in [{low}, {high}], residual {residual}")


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance that aren't 0, falling, and their eigenvectors as columns; fewer if there are fewer."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast(v, *held) for held in intervals(v, most)]
    values, vectors = zip(*found, strict=True)
    return np.concatenate(values)[:most], np.hstack(vectors)[:, :most]


def _whole(vec: str) -> Column:
    """The integer vector, or null where an entry is null or not finite."""
    c = F.col(vec)
    fine = ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & (F.size(c) > 0)
    return F.when(fine, F.transform(c, lambda e: F.floor(e.cast("double") * SCALE)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added_up(partials: DataFrame) -> DataFrame:
    """Sums of the arrays ``v`` per ``i`` over all ``part``: FAN_IN parts at a time, until one is left."""

    def add(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("v").combine_chunks()).sum(0)
        return pa.table({"i": group.column("i")[:1], "part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), "v": pa.array([v])})

    parts = (partials.agg(F.max("part")).head()[0] or 0) + 1
    while True:
        partials = partials.groupBy("i", F.floor(F.col("part") / FAN_IN)).applyInArrow(add, "i int, part long, v array<double>")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return partials
        partials = materialise(partials, "whitening-sums")


def _sums(fit: DataFrame, width: int) -> list[int]:
    """Exact sums of each dimension: high and low halves are added apart, so that no partial sum passes 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "high": high, "low": low})

    found = fit.select("x").mapInArrow(run, "i int, high long, low long")
    found = found.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    by = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in found.collect()}
    return [by.get(i, 0) for i in range(width)]


def _products(fit: DataFrame, width: int, made) -> np.ndarray:
    """The sum over all rows of ``made(x)`` (a row each) times its own transpose, and the rows' sum as a last line; ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((width + 1, width))
        for batch in batches:
            z = made(_matrix(batch.column(0)))
            total[:-1] += z.T @ z
            total[-1] += z.sum(0)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(width + 1), pa.int32()), "part": pa.array([part] * (width + 1), pa.int64()), "v": pa.array(list(total))},
        )

    partials = materialise(fit.select("x").mapInArrow(run, "i int, part long, v array<double>"), "whitening-parts")
    out = np.zeros((width + 1, width))
    for r in _added_up(partials).collect():
        out[r["i"]] = r["v"]
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    reach = (n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, sums))) ** 2 * len(sums)
    kind = np.int64 if reach < 1 << 63 else object
    off = n * x.astype(kind) - np.array(sums, kind)
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(1)]


def whiten(rows: DataFrame, ident: str = "vec_id", vec: str = "embedding", most: int = 4) -> DataFrame:
    """``ident, component, n, deviation, whitened, explained, identity_error``: a row per usable row and component."""
    small_batches(rows.sparkSession, 5000)
    good = rows.select(F.col(ident).alias("id"), _whole(vec).alias("x")).where("x is not null")
    kind = good.schema["id"].dataType.simpleString()
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(kind)
    common = good.groupBy(F.size("x").alias("width")).count().orderBy(F.col("count").desc(), F.col("width").desc()).head()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", ident)
    width = common["width"]
    good = good.where(F.size("x") == width)
    fit = materialise(good.groupBy("x").agg(F.lit(1).alias("one")), "whitening-fit")
    n, sums = fit.count(), _sums(fit, width)
    mean = np.array([s / n for s in sums])
    v = _products(fit, width, lambda x: x - mean)[:-1] / n
    values, vectors = components((v + v.T) / 2, most)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", ident)
    explained = (values / np.trace(v)).tolist()
    to = vectors / np.sqrt(values)
    k = len(values)
    held = _products(fit, k, lambda x: (x - mean) @ to)
    error = float(np.abs(held[:-1] / n - np.outer(held[-1] / n, held[-1] / n) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            again = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(again), pa.array(((x - mean) @ to).ravel()),
                    pa.array(explained * len(x)), pa.array(np.full(k * len(x), error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.mapInArrow(run, schema).withColumnRenamed("id", ident)

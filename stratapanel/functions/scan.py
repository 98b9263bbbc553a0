"""Operators along time in one pass over sorted rows.

Rows are dealt by symbol, sorted by time, and go through numpy in runs of many symbols, or of a part of a long one: what the next run
needs of a symbol is carried over (the last rows of the widest window, the states of recursions).  No operator costs more per row for
a wider window, but for the logarithm in ranks:

* sums, means, moments and extremes: a symbol's rows are cut into blocks of one window; running totals from the front and from the back of
  each block add up to any window.  Moments are merged from the two parts' central moments, so no digits cancel.
  Sums and means of up to 16 rows are added from the oldest value on instead: windows with the same values then have the same mean, so
  that differences of two means are exactly 0 there and tie.
* ranks: a window is the union of at most 2 log2(w) aligned runs of 2**k rows, each sorted once for all windows; bisection in them counts
  the values below the current one.
* exponential averages: the recursion is a composition of affine maps x -> a x + b, made by doubling.

Missing values are NULL in columns and NaN here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .ts import FLAT, SYM, T, least_obs

#: Rows that are computed at once, at least.
ROWS = 1 << 16
#: Windows up to here are added up row by row.
NARROW = 16


@dataclass(frozen=True)
class Scan:
    """``kind`` of a column over the last ``w`` rows: mean, std, std_samp, sum, max, min, skew, kurt, rank, rank_or_0, pct_rank; ema over all rows.

    ``least`` is the number of values from which on there is a result.  ``span``: the window is of ``w`` steps of the time column, not of rows.
    ``start``, for an exponential average: a column with each symbol's state before its first row, NULL where it has none.
    """

    kind: str
    source: str
    w: int
    least: int
    span: bool = False
    start: str | None = None


def scan(kind: str, source: str, w: int, least: int | None = None, span: bool = False, start: str | None = None) -> Scan:
    full = {"skew": w, "kurt": w, "ema": w}
    return Scan(kind, source, w, least if least is not None else full.get(kind, least_obs(w)), span, start)


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All maps up to each row, one after the other: of x -> a x + b, by doubling."""
    a, b, reach = a.copy(), b.copy(), 1
    while reach < len(a):
        b[reach:] += a[reach:] * b[:-reach]
        a[reach:] *= a[:-reach]
        reach *= 2
    return a, b


class Blocks:
    """Rows laid out by blocks of ``w`` rows of a symbol; ``place`` is a row's number within its symbol."""

    def __init__(self, code: np.ndarray, place: np.ndarray, w: int):
        self.w, at = w, place // w
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
        self.row, self.col = np.cumsum(fresh) - 1, place % w
        first = np.flatnonzero(fresh)
        # whether the block before is of the same symbol, and the window reaches into it
        self.joined = np.zeros(len(first), bool)
        self.joined[1:] = code[first[1:]] == code[first[:-1]]
        self.reaches = self.joined[self.row] & (self.col < w - 1)
        self.shape = (len(first), w)

    def laid(self, x: np.ndarray, missing: float) -> np.ndarray:
        grid = np.full(self.shape, missing)
        grid[self.row, self.col] = np.where(np.isnan(x), missing, x)
        return grid

    def parts(self, grid: np.ndarray, join: np.ufunc, none: float) -> tuple[np.ndarray, np.ndarray]:
        """What lies in the row's own block up to it, and in the block before from the window's beginning on."""
        front = join.accumulate(grid, axis=1)[self.row, self.col]
        back = join.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
        before = np.full(len(front), none)
        at = np.flatnonzero(self.reaches)
        before[at] = back[self.row[at] - 1, self.col[at] + 1]
        return front, before

    def total(self, x: np.ndarray) -> np.ndarray:
        front, before = self.parts(self.laid(x, 0.0), np.add, 0.0)
        return front + before

    def extreme(self, x: np.ndarray, join: np.ufunc) -> np.ndarray:
        none = -np.inf if join is np.maximum else np.inf
        return join(*self.parts(self.laid(x, none), join, none))

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number, and sums of the second, third and fourth powers of what lies off the mean."""
        held = self.laid(x, np.nan)
        some = ~np.isnan(held)
        first = np.argmax(some, axis=1)
        anchor = np.where(some.any(1), held[np.arange(len(held)), first], 0.0)
        off = np.where(some, held - anchor[:, None], 0.0)
        sums = [self.parts(some.astype(float), np.add, 0.0), *[self.parts(off**k, np.add, 0.0) for k in (1, 2, 3, 4)]]
        base = (anchor[self.row], np.where(self.reaches, anchor[self.row - 1], 0.0))
        (na, ma, *a), (nb, mb, *b) = (self._central([s[i] for s in sums], base[i]) for i in (1, 0))
        n = na + nb
        safe = np.maximum(n, 1)
        d = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
        two = a[0] + b[0] + d**2 * na * nb / safe
        three = a[1] + b[1] + d**3 * na * nb * (na - nb) / safe**2 + 3 * d * (na * b[0] - nb * a[0]) / safe
        four = a[2] + b[2] + d**4 * na * nb * (na**2 - na * nb + nb**2) / safe**3
        four += 6 * d**2 * (na**2 * b[0] + nb**2 * a[0]) / safe**2 + 4 * d * (na * b[1] - nb * a[1]) / safe
        return n, two, three, four

    @staticmethod
    def _central(sums: list[np.ndarray], base: np.ndarray) -> tuple[np.ndarray, ...]:
        n, s1, s2, s3, s4 = sums
        m = s1 / np.maximum(n, 1)
        two = np.maximum(s2 - m * s1, 0.0)
        three = s3 - 3 * m * s2 + 2 * m**2 * s1
        return n, base + m, two, three, s4 - 4 * m * s3 + 6 * m**2 * s2 - 3 * m**3 * s1


def counts_below(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row i, over the rows ``low[i]`` to i: how many values lie below that of row i, how many equal it, how many there are."""
    held = np.flatnonzero(~np.isnan(x))
    kinds, rank = np.unique(x[held], return_inverse=True)
    value = np.zeros(len(x), np.int64)
    value[held] = rank
    below, same, count = (np.zeros(len(x), np.int64) for _ in range(3))
    left, right, level, width = low.copy(), np.arange(len(x)) + 1, 0, len(kinds) + 1
    while (left < right).any():
        keys = np.sort((held >> level) * width + rank)

        def add(rows: np.ndarray, block: np.ndarray, keys: np.ndarray = keys) -> None:
            start, lower, upper, end = (np.searchsorted(keys, block * width + v) for v in (0, value[rows], value[rows] + 1, width))
            below[rows] += lower - start
            same[rows] += upper - lower
            count[rows] += end - start

        rows = np.flatnonzero((left < right) & (left & 1 == 1))
        add(rows, left[rows])
        left[rows] += 1
        rows = np.flatnonzero((left < right) & (right & 1 == 1))
        right[rows] -= 1
        add(rows, right[rows])
        left, right, level = left >> 1, right >> 1, level + 1
    return below, same, count


class Run:
    """Rows that are computed at once, with the rows carried over in front: codes of symbols, numbers within symbols, times."""

    def __init__(self, code: np.ndarray, place: np.ndarray, time: np.ndarray):
        self.code, self.place, self.time = code, place, time
        fresh = np.ones(len(code), bool)
        fresh[1:] = code[1:] != code[:-1]
        self.fresh = fresh
        self.start = np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))
        self.blocks: dict[int, Blocks] = {}

    def by(self, w: int) -> Blocks:
        if w not in self.blocks:
            self.blocks[w] = Blocks(self.code, self.place, w)
        return self.blocks[w]

    def low(self, s: Scan) -> np.ndarray:
        """The first row of each window."""
        if not s.span:
            return np.maximum(self.start, np.arange(len(self.code)) - s.w + 1)
        width = int(self.time.max() - self.time.min()) + s.w + 2
        key = self.code * width + (self.time - self.time.min()) + s.w
        return np.maximum(self.start, np.searchsorted(key, key - s.w + 1))

    def added(self, x: np.ndarray, w: int) -> np.ndarray:
        """Sums of the last ``w`` rows, from the oldest on."""
        out, held = np.zeros(len(x)), np.where(np.isnan(x), 0.0, x)
        inside = np.arange(len(x)) - self.start
        for back in range(min(w, len(x)) - 1, -1, -1):
            out[back:] += np.where(inside[back:] >= back, held[: len(x) - back], 0.0)
        return out

    def ranked(self, s: Scan, x: np.ndarray) -> np.ndarray:
        below, same, count = counts_below(x, self.low(s))
        out = (below + (same + 1) / 2) / np.maximum(count, 1) if s.kind == "pct_rank" else below / np.maximum(count - 1, 1)
        out = np.where(np.isnan(x), 0.0 if s.kind == "rank_or_0" else np.nan, out)
        return np.where(count >= s.least, out, np.nan)

    def computed(self, s: Scan, x: np.ndarray) -> np.ndarray:
        if s.kind in ("rank", "rank_or_0", "pct_rank"):
            return self.ranked(s, x)
        blocks = self.by(s.w)
        count = blocks.total(np.where(np.isnan(x), np.nan, 1.0))
        with np.errstate(all="ignore"):
            if s.kind in ("sum", "mean"):
                out = (self.added(x, s.w) if s.w <= NARROW else blocks.total(x)) / (count if s.kind == "mean" else 1)
            elif s.kind in ("max", "min"):
                out = blocks.extreme(x, np.maximum if s.kind == "max" else np.minimum)
            else:
                n, two, three, four = blocks.moments(x)
                var = two / n
                out = {
                    "std": lambda: np.sqrt(var), "std_samp": lambda: np.sqrt(two / (n - 1)),
                    "skew": lambda: np.where(var > FLAT, three / n / var**1.5, np.nan),
                    "kurt": lambda: np.where(var > FLAT, four / n / var**2 - 3, np.nan),
                }[s.kind]()
        return np.where(count >= s.least, out, np.nan)

    def averaged(self, s: Scan, x: np.ndarray, held: tuple[float, int] | None, start: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
        """An exponential average; ``held`` is the state of the first symbol and the values seen, if rows of it came before; those of the last
        symbol come back.  A state in ``start`` counts as a value that was seen."""
        alpha = 2.0 / (s.w + 1)
        state, seen = held or (0.0, 0)
        some = ~np.isnan(x)
        begun = self.fresh & (~np.isnan(start) if start is not None else False)
        begun[0] &= held is None
        count = np.cumsum(some)
        count = count - np.where(self.start > 0, count[self.start - 1], 0) + np.where(self.code == self.code[0], seen, 0) + begun[self.start]
        seed = some & (count == 1)
        a = np.where(some, 1 - alpha, 1.0)
        b = np.where(some, alpha * np.where(some, x, 0.0), 0.0)
        a[seed], b[seed] = 0.0, x[seed]
        if start is not None:
            b[begun] += a[begun] * start[begun]
        new = self.fresh & (begun | ~some)
        new[0] &= held is None
        a[new] = 0.0  # nothing of the symbol before
        a, b = compose(a, b)
        out = a * state + b
        return np.where(count >= s.least, out, np.nan), float(out[-1]), int(count[-1])


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.cast(column, pa.float64()).to_numpy(), float)


def scans(frame: DataFrame, wanted: dict[str, Scan], key: str = SYM, time: str = T) -> DataFrame:
    """``frame`` with a column per entry of ``wanted``; one exchange by symbol, none where it is dealt by symbol already."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + "".join(f", `{c}` double" for c in wanted)
    tail = max((s.w - 1 for s in wanted.values() if s.kind != "ema"), default=0)
    sources = sorted({s.source for s in wanted.values()})

    def coded(keys: pa.ChunkedArray) -> np.ndarray:
        """Numbers that rise where the symbol changes."""
        keys = keys.combine_chunks()
        changed = np.zeros(len(keys), np.int64)
        if len(keys) > 1:
            a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
            changed[1:] = ~same
        return np.cumsum(changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict | None = None  # the last symbol: its name, rows, times, values, states
        for rows in _gathered(batches):
            code, n, old = coded(rows.column(key)), rows.num_rows, 0
            when, values = np.asarray(rows.column(time).to_numpy(), np.int64), {c: _floats(rows.column(c)) for c in sources}
            again = kept is not None and kept["key"] == rows.column(key)[0].as_py()
            offset = kept["rows"] if again else 0
            if again:
                old = len(kept["time"])
                code = np.concatenate([np.zeros(old, np.int64), code])
                when = np.concatenate([kept["time"], when])
                values = {c: np.concatenate([kept["values"][c], v]) for c, v in values.items()}
            start = np.maximum.accumulate(np.where(np.diff(code, prepend=-1) > 0, np.arange(len(code)), 0))
            place = np.arange(len(code)) - start + np.where(code == 0, offset - old, 0)
            whole, own = Run(code, place, when), Run(code[old:], place[old:], when[old:])
            out, states = [], {}
            for name, s in wanted.items():
                if s.kind == "ema":
                    start = _floats(rows.column(s.start)) if s.start else None
                    made, *states[name] = own.averaged(s, values[s.source][old:], kept["states"][name] if again else None, start)
                else:
                    made = whole.computed(s, values[s.source])[old:]
                out.append(pa.array(made, pa.float64(), mask=np.isnan(made)))
            cut = max(int(whole.start[-1]), len(code) - tail) if tail else len(code)
            kept = {
                "key": rows.column(key)[n - 1].as_py(), "rows": int(place[-1]) + 1, "time": when[cut:],
                "values": {c: v[cut:] for c, v in values.items()}, "states": states,
            }
            for column, name in zip(out, wanted, strict=True):
                rows = rows.append_column(name, column)
            yield from rows.to_batches()

    return frame.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)

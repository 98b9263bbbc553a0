"""Whole texts as numpy arrays: bytes or code points of a batch in one array, words and their hashes without a loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x100000001B3  # odd, so it has an inverse modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values (splitmix64)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


#: Longer runs get a cryptographic digest: polynomials modulo 2**64 have known collisions from 1,024 units on.
_LONG_RUN = 512


def run_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run units[start:end]: a polynomial modulo 2**64 from one running sum, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _powers(len(units), _STEP), out=sums[1:])
    back = _powers(len(units) + 1, pow(_STEP, -1, 1 << 64))
    out = mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _ODD)
    for i in np.flatnonzero(ends - starts > _LONG_RUN).tolist():
        digest = hashlib.blake2b(units[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def chunks(texts: Iterable[str | None], most: int, rows: int = 1 << 30) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, about ``most`` characters (one longer text stands alone) and at most ``rows`` together, with the place of the first."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if held and (size + len(text) > most or len(held) >= rows):
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of anything but ASCII white space) of all texts in order, and the number of words of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    units = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    start, end = runs(~_SPACE[units])
    per = np.diff(np.searchsorted(start, ends), prepend=0)
    return run_hashes(units, start, end), per


_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x10000)], np.uint32)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each text followed by a line break; which are letters; and the ends of the texts."""
    joined = "\n".join(texts) + "\n"
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    small = units < 0x10000
    low = np.where(small, units, 0)
    is_letter = _LETTER[low] & small
    if not small.all():
        rare = np.unique(units[~small])
        is_letter |= np.isin(units, [u for u in rare.tolist() if chr(u).isalpha()])
    return np.where(small, _LOWER[low], units), is_letter, ends

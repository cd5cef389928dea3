"""Anchors: a sparse set of places in texts from which all windows of a given length can be reached.

Every window of `length` symbols has one anchor, its k-gram of least hash (the leftmost of equals), so equal windows have
equal anchors at equal offsets. Windows that follow one another share an anchor mostly; such a run of windows is named by
the hash of its anchor's k-gram and the hash of all symbols the run spans. About 2 / (length - k + 2) of the places are anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from xxhash import xxh3_64_intdigest as digest

_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 2**63, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


@dataclass
class Symbols:
    """Some texts as one row of symbols: the bytes that symbol i is made of are data[begin[i]:end[i]], and code[i] is a hash of it; text t has the symbols edges[t] to edges[t + 1]."""

    data: memoryview
    begin: np.ndarray
    end: np.ndarray
    code: np.ndarray
    edges: np.ndarray

    def hash(self, first: int, last: int) -> int:
        """Of symbols first to last, both included."""
        return digest(self.data[self.begin[first] : self.end[last]])


def of_bytes(texts: list[bytes], coded: bool = True) -> Symbols:
    data = b"".join(texts)
    at = np.arange(len(data) + 1)
    return Symbols(memoryview(data), at[:-1], at[1:], _BYTES[np.frombuffer(data, np.uint8)] if coded else at[:0], np.cumsum([0, *map(len, texts)]))


def of_words(texts: list[bytes], coded: bool = True) -> Symbols:
    rows = [t.split() for t in texts]
    words = [w for r in rows for w in r]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    return Symbols(memoryview(b" ".join(words)), end - sizes, end, np.array([digest(w) for w in words] if coded else [], np.uint64) | np.uint64(1), np.cumsum([0, *map(len, rows)]))


@dataclass
class Runs:
    """Runs of windows: text, anchor and first window (symbols, counted in the text), number of windows."""

    text: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    count: np.ndarray


def runs(symbols: Symbols, length: int, k: int) -> Runs:
    n, edges = len(symbols.code), symbols.edges
    none = np.zeros(0, np.int64)
    if n < length:
        return Runs(none, none, none, none)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols.code * _powers(_STEP, n), out=sums[1:])
    grams = (sums[k:] - sums[:-k]) * _powers(_BACK, n - k + 1)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    # the least of each window by hash, then place
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, done = length - k + 1, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    starts = np.flatnonzero(_inside(edges, n, length))
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(starts):
        return Runs(none, none, none, none)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first = starts[at]
    text = np.searchsorted(edges, first, "right") - 1
    return Runs(text, anchor[at] - edges[text], first - edges[text], np.diff(np.append(at, len(starts))))


def _inside(edges: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether the window that starts at each place ends in the same text."""
    ok = np.zeros(n + 1, np.int32)
    begin, last = edges[:-1], edges[1:] - length + 1
    long = last > begin
    np.add.at(ok, begin[long], 1)
    np.add.at(ok, last[long], -1)
    return np.cumsum(ok)[:n] > 0

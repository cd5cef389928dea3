"""Groups of suffixes that share a prefix, as sorted suffixes with the common prefixes of neighbours.

A row is a run of windows around one anchor: `lead` symbols before it, and the symbols of all its windows. Rows of one group
have the k symbols at the anchor in common. Their suffixes from the anchor on are sorted, and so are, backwards, the symbols
before it; the common prefix of neighbours in each order cuts it into the nodes of a tree at every depth (neighbours are in
one node of depth n as long as they have n symbols in common). A window that begins d symbols before the anchor is one node of
depth d backwards and one of depth length - d forwards, so from the sorted suffixes follow, step by step to the left, the
classes of all windows, and in each class all but the first are repeated. Only symbols are compared, no hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Group:
    """Rows in the order of (doc, tag, anchor). group: number of the rows' group; symbols: codes from 1 on, row by row, starts[i] being where row i begins (one more entry for the end)."""

    group: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    lead: np.ndarray
    count: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray

    def around(self, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols from each anchor on, and before it backwards; 0 where a row has none."""
        padded = np.append(self.symbols, np.zeros(1, self.symbols.dtype))
        anchor, end = (self.starts[:-1] + self.lead)[:, None], self.starts[1:][:, None]
        right, left = anchor + np.arange(length), anchor - 1 - np.arange(length - k)
        none = len(self.symbols)
        return padded[np.where(right < end, right, none)], padded[np.where(left >= self.starts[:-1][:, None], left, none)]


def ordered(rows: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows of symbols, and how many symbols each row has in common with the one before it in that order; head: numbers that come before the symbols (-1 if they differ)."""
    n, width = rows.shape
    if not width:
        order = np.argsort(head, kind="stable") if head is not None else np.arange(n)
        common = np.zeros(n, np.int64)
    else:
        data = np.ascontiguousarray(rows.astype(rows.dtype.newbyteorder(">"))).view(np.uint8).reshape(n, -1)
        if head is not None:
            data = np.hstack([head.astype(">u4").view(np.uint8).reshape(n, 4), data])
        order = np.argsort(np.ascontiguousarray(data).view(f"S{data.shape[1]}").ravel(), kind="stable")
        other = rows[order][1:] != rows[order][:-1]
        common = np.zeros(n, np.int64)
        common[1:] = np.where(other.any(axis=1), other.argmax(axis=1), width)
    common[:1] = -1
    if head is not None:
        common[1:][head[order][1:] != head[order][:-1]] = -1
    return order, common


def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The number of each row's node of that depth."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def later_in_class(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, same_doc: bool) -> np.ndarray:
    """Which rows, given in the order of (doc, tag, place), come after the first of those with equal keys: those of another document than the first one's or, with same_doc, after one of their own."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else order
    later = d != d[first]
    if same_doc and len(k):
        t = tag[order]
        later[1:] |= ~new[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1])
    out = np.empty(len(k), bool)
    out[order] = later
    return out


def repeated(rows: Group, length: int, k: int, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: row, first window (from the row's first one) and number of windows."""
    n, widest = len(rows.doc), length - k
    right, left = rows.around(length, k)
    by_right, by_left = ordered(right, rows.group), ordered(left)
    # column c: the window `widest - c` symbols before the anchor; one more column on each side
    hits = np.zeros((n, widest + 3), bool)
    for d in range(widest + 1):
        at = np.flatnonzero((d <= rows.lead) & (d > rows.lead - rows.count))
        key = nodes(*by_left, d)[at] * (n + 1) + nodes(*by_right, length - d)[at]
        hits[at, widest - d + 1] = later_in_class(key, rows.doc[at], rows.tag[at], same_doc)
    begins, ends = np.nonzero(hits[:, 1:] & ~hits[:, :-1]), np.nonzero(~hits[:, 1:] & hits[:, :-1])
    row = begins[0]
    return row, begins[1] - (widest - rows.lead[row]), ends[1] - begins[1]

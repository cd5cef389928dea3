"""Exact byte-pair merges for many words at once, from a public tokenizer's JSON description.

The vocabulary file is read on the driver from a path the caller gives and sent to the tasks as one broadcast of fixed size.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

import numpy as np

_NONE = np.int32(2**31 - 1)
#: Longer words are merged one by one with a heap, so that a word of a million letters costs n log n.
LONG = 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Endings:
    """Tokens read from their last byte to the first, as a trie."""

    def __init__(self, tokens: dict[bytes, int]) -> None:
        children: dict[int, int] = {}
        ids = [-1]
        for name, token in tokens.items():
            node = 0
            for b in reversed(name):
                key = node << 8 | b
                if (node := children.get(key, 0)) == 0:
                    node = children[key] = len(ids)
                    ids.append(-1)
            ids[node] = token
        keys, nodes = np.array(list(children), np.int64), np.array(list(children.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]
        self.ids = np.array([*ids, -1], np.int32)  # node -1 is none

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes one byte further, and the token of each, or -1."""
        keys = nodes << 8 | letters
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = np.where(self.keys[at] == keys, self.nodes[at], -1)
        return out, self.ids[out]


class Merges:
    """The merge rules of one vocabulary."""

    def __init__(self, description: bytes):
        told = json.loads(description)
        model = told["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        rules = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.width = 1 + max(vocab.values())
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in rules], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in rules], np.int32)
        self.by_pair = dict(zip(pairs.tolist(), range(len(rules))))
        self.names: list[bytes] = [b""] * (1 + max([self.width - 1, *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name.encode()
        value = {c: bytes([b]) for b, c in enumerate(letters)}
        self.bytes_of = {i: b"".join(map(value.__getitem__, name.removesuffix(suffix) if suffix else name)) for name, i in vocab.items() if i not in self.special.values() and all(c in value for c in name.removesuffix(suffix))}
        self.whole = {b: i for i, b in self.bytes_of.items()} if not suffix else {}
        self.longest = max(map(len, self.whole), default=0)
        self.sound: list[bool] | None = None
        self._endings: Endings | None = None

    def endings(self) -> Endings:
        if self._endings is None:
            self._endings = Endings(self.whole)
        return self._endings

    def keep(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens (or, with -1 as the left one, of the right one alone) gives these tokens. For two, their own merges are undone from the last one back, each time asking whether a pair across the seam would have been merged before; at equal rank the pair further left is."""
        if self.sound is None:
            self._split()
        if not self.sound[right] or (left >= 0 and not self.sound[left]):
            return False
        if left < 0:
            return True
        if left in self.many or right in self.many:
            return self.merge([self.bytes_of[left] + self.bytes_of[right]])[0].tolist() == [left, right]
        by_pair, split, width, limit = self.by_pair, self.split, self.width, _NONE
        while True:
            made = by_pair.get(left * width + right)
            if made is not None and made < limit:
                return False
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def _split(self) -> None:
        """Of each token, the rule that makes it and its two parts; which tokens more than one rule makes; which ones their own bytes are merged to."""
        parts = {p: divmod(p, self.width) for p in self.by_pair}
        self.split = {int(self.made[r]): (r, *parts[p]) for p, r in self.by_pair.items()}
        times = np.bincount(self.made, minlength=self.width)
        self.many = set(np.flatnonzero(times > 1).tolist())
        tokens = list(self.bytes_of)
        flat, starts = self.merge([self.bytes_of[t] for t in tokens])
        self.sound = [False] * self.width
        for t, n, i in zip(tokens, np.diff(starts).tolist(), starts.tolist()):
            self.sound[t] = n == 1 and int(flat[i]) == t

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's rule, or _NONE. Negative ids mark padding."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, end to end, and where each word's begin (one more entry for the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        short = order[(sizes[order] > 0) & (sizes[order] <= LONG)]
        n = np.zeros(len(words), np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(short), 20_000):
            rows = short[k : k + 20_000]
            ids, n[rows] = self._together([words[i] for i in rows.tolist()], sizes[rows])
            made.append((rows, ids))
        for i in order[sizes[order] > LONG].tolist():
            ids = self._alone(words[i])
            n[i] = len(ids)
            made.append((np.array([i]), ids[None]))
        starts = np.concatenate([[0], np.cumsum(n)])
        flat = np.zeros(int(starts[-1]), np.int32)
        for rows, ids in made:
            places = np.arange(ids.shape[1])
            used = places < n[rows][:, None]
            flat[(starts[rows][:, None] + places)[used]] = ids[used]
        return flat, starts

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(sizes.max())
        data = np.frombuffer(b"".join(words), np.uint8)
        used = np.arange(width) < sizes[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[used] = self.inner[data]
        ends = np.cumsum(sizes) - 1
        ids[np.arange(n), sizes - 1] = self.last[data[ends]]
        out, left = ids.copy(), sizes.copy()
        rows = np.arange(n)
        ranks = np.full((n, width), _NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        places = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best != _NONE
            if not go.all():
                out[rows[~go]] = ids[~go]
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = self.made[best]
            move = np.minimum(places + (places > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, move, 1), np.take_along_axis(ranks, np.minimum(places + (places >= at[:, None]), width - 1), 1)
            left[rows] -= 1
            # the last column repeats its neighbour after the move
            ids[:, -1], ranks[:, -1] = -1, _NONE
            nxt = np.minimum(at + 1, width - 1)
            ranks[each, at] = self.rank(ids[each, at], np.where(at + 1 < width, ids[each, nxt], -1))
            prev = np.maximum(at - 1, 0)
            ranks[each, prev] = np.where(at > 0, self.rank(ids[each, prev], ids[each, at]), ranks[each, prev])
        return out, left

    def _alone(self, word: bytes) -> np.ndarray:
        data = np.frombuffer(word, np.uint8)
        ids = self.inner[data].tolist()
        ids[-1] = int(self.last[data[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.by_pair.get(ids[i] * self.width + ids[j])) is not None:
                heap.append((r, i, ids[i], ids[j])) if not started else heapq.heappush(heap, (r, i, ids[i], ids[j]))

        started = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)


def split_special(text: bytes, special: Iterable[bytes]) -> list[tuple[bytes, bool]]:
    """text as (part, whether it is a special string)."""
    parts = [(text, False)]
    for s in special:
        parts = [y for x, is_special in parts for y in ([(x, True)] if is_special else [z for k, p in enumerate(x.split(s)) for z in ([(s, True), (p, False)] if k else [(p, False)])])]
    return [x for x in parts if x[0]]

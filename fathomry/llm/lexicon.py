"""A minimal acyclic transducer from words to token ids, kept in one flat file that tasks map into memory.

States with equal futures are one state, so words share their suffixes as well as their prefixes. Each edge carries the number
of words that sort before the ones behind it; the sum along a word's path is the word's number, which leads to its ids.
"""

from __future__ import annotations

import numpy as np


def compile_words(words: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
    """The file as int32: five sizes, edge keys (state * 256 + byte, ascending), edge targets, edge numbers, whether a state ends a word, where each word's ids begin, ids. words: sorted, distinct, not empty."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]  # states of the last word, none of which is shared yet
    last = b""

    def share(down_to: int) -> None:
        """Replaces the last word's states below that depth by equal ones known from earlier, deepest first."""
        for depth in range(len(path) - 1, down_to, -1):
            state = path.pop()
            form = (final[state], *edges[state].items())
            edges[path[-1]][last[depth - 1]] = known.setdefault(form, state)

    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        share(same)
        for byte in word[same:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    share(0)

    number: dict[int, int] = {}  # the kept states, renumbered as they are reached
    todo = [0]
    while todo:
        state = todo.pop()
        if state not in number:
            number[state] = len(number)
            todo += edges[state].values()
    behind: dict[int, int] = {}  # words that a state leads to
    for root in number:
        stack = [root]
        while stack:
            s = stack[-1]
            if missing := [t for t in edges[s].values() if t not in behind]:
                stack += missing
            else:
                behind[s] = final[s] + sum(behind[t] for t in edges[s].values())
                stack.pop()
    rows = []
    for state, k in number.items():
        before = int(final[state])
        for byte, target in sorted(edges[state].items()):
            rows.append((k * 256 + byte, number[target], before))
            before += behind[target]
    rows.sort()
    table = np.array(rows, np.int32).reshape(-1, 3)
    ends = np.zeros(len(number), np.int32)
    for state, k in number.items():
        ends[k] = final[state]
    begins = np.zeros(len(words) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=begins[1:])
    flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
    sizes = np.array([len(table), len(ends), len(words), len(flat), 0], np.int32)
    return np.concatenate([sizes, *table.T, ends, begins, flat]).astype(np.int32)


class Lexicon:
    """A compiled file, opened read-only."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int32, "r")
        n_edges, n_states, n_words, n_ids, _ = data[:5].tolist()
        cuts = np.cumsum([5, n_edges, n_edges, n_edges, n_states, n_words + 1, n_ids])
        self.keys, self.targets, self.numbers, self.ends, self.begins, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:]))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        starts = np.cumsum(sizes) - sizes
        rows = np.flatnonzero(sizes)
        state = np.zeros(len(rows), np.int64)
        total = np.zeros(len(rows), np.int64)
        step = 0
        while len(rows):
            key = state * 256 + data[starts[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            rows, at, total = rows[on], at[on], total[on]
            state = self.targets[at].astype(np.int64)
            total = total + self.numbers[at]
            step += 1
            done = sizes[rows] == step
            hit = done & (self.ends[state] == 1)
            out[rows[hit]] = total[hit]
            rows, state, total = rows[~done], state[~done], total[~done]
        return out

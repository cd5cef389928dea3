"""Runs: stretches of words that repeat with a period, four times over or more.

Words are appended one by one to a suffix automaton, whose suffix links form a tree. An access, as of a link-cut tree, recolours
the path from the new prefix's state to the root with its end. Each segment of one old colour that it meets says where the
segment's longest string last ended before: where the distance of the two ends is no more than a third of that string's length,
the words up to here have that distance as a period. Such a finding is extended to both sides, which makes it a run. The tree of
a stretch is built before its words are replayed, so it does not change; its preferred paths are kept as stacks of segments
over heavy paths, and an access crosses a logarithmic number of those.

Only stretches that can hold a run come to the automaton. A run of period q has at least max(6, 4q) words, so each 5 words that
start in it occur again, or before, at most a quarter of its length away. Stretches of places whose 5 words do so are found in
Arrow columns of many documents at once, by hashes; equal hashes of different words only add a stretch. Nothing is shuffled: a
document's runs depend on its own words.

Defined results: a null or empty text, or one of white space, has no runs, null details and an empty collapsed text; texts may
be of any length, and a task holds some 2 MB of texts or one text, with about a kilobyte for each word of its longest stretch;
equal rows get equal results; runs of equal exponent: the first start, then the least period, counts as the greatest; an empty
table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, append, raw, table

#: Fewest words of a run, and fewest periods.
LEAST, TIMES = 6, 4
#: Words in a gram of the search for stretches: with these, each gram of a run has an equal one within its period.
GRAM = 5

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts, equal for equal words; the texts' first places and the end."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    solid = np.r_[False, ~_SPACE[data], False]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = edges[::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(stops - starts)].astype(np.int64)
    kept = pa.py_buffer(data[solid[1:-1]].tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), kept])
    ids = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.r_[0, np.searchsorted(starts, ends)]


def stretches(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first, end) of the places among which every run lies."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    mixed = np.random.default_rng(5).integers(0, 1 << 63, (GRAM, int(ids.max()) + 1), np.uint64)
    h = text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(GRAM):
        h += mixed[k][ids[k : k + n]]
    whole = text[:n] == text[GRAM - 1 :]
    slot = (h >> np.uint64(12)).astype(np.int64) & ((1 << 20) - 1)
    live = whole & (np.bincount(slot[whole], minlength=1 << 20)[slot] > 1)
    at = np.flatnonzero(live)
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at[1:]] == h[at[:-1]]
    away = np.full(n, len(ids))
    a, b = at[:-1][same], at[1:][same]
    away[a] = b - a
    away[b] = np.minimum(away[b], b - a)
    live = away < len(ids)
    while live.any():  # what is struck out may shorten a stretch, so that more of it goes; no gram crosses texts, so no stretch does
        edge = np.flatnonzero(np.diff(np.r_[False, live, False].astype(np.int8)))
        firsts, ends = edge[::2], edge[1::2]
        size = np.zeros(n, np.int64)
        size[live] = np.repeat(ends - firsts + GRAM - 1, ends - firsts)
        stays = live & (size >= LEAST) & (away * TIMES <= size)
        if (stays == live).all():
            return [(int(text[i]), int(i - bounds[text[i]]), int(j + GRAM - 1 - bounds[text[i]])) for i, j in zip(firsts, ends)]
        live = stays
    return []


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of the words: lengths, suffix links, and the state of each prefix."""
    size, link, nexts, prefix, last = [0], [-1], [{}], [], 0
    for w in words:
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        nexts.append({})
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            if size[q] != size[p] + 1:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                nexts.append(nexts[q].copy())
                while p >= 0 and nexts[p].get(w) == q:
                    nexts[p][w] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        prefix.append(new)
        last = new
    return size, link, prefix


def heads(size: list[int], link: list[int]) -> list[int]:
    """Of each state the top of its heavy path in the tree of links."""
    order = np.argsort(size, kind="stable").tolist()
    weight = [1] * len(size)
    heavy = [0] * len(size)
    best = [0] * len(size)
    for v in reversed(order[1:]):
        u, x = link[v], weight[v]
        weight[u] += x
        if x > best[u]:
            best[u], heavy[u] = x, v
    head = list(range(len(size)))
    for v in order[1:]:
        if heavy[link[v]] == v and link[v]:
            head[v] = head[link[v]]
    return head


def repeats(words: list[int]) -> set[tuple[int, int]]:
    """(place, distance): the words up to the place have the distance as a period, over TIMES of it and LEAST words or more. Of a stretch that goes on with the same period one place is given."""
    size, link, prefix = automaton(words)
    head = heads(size, link)
    colours: list[list[tuple[int, int]] | None] = [None] * len(size)  # of each path, segments (length at the bottom, end), the topmost last
    found, upto = set(), {}
    times = TIMES - 1
    for j, v in enumerate(prefix):
        while v:
            top, long = head[v], size[v]
            path = colours[top]
            if path is None:
                colours[top] = [(long, j)]
            else:
                met = 0
                while path and path[-1][0] <= long:
                    met, end = path.pop()
                    d = j - end
                    if met >= times * d and met + d >= LEAST:
                        if upto.get(d, -2) != j - 1:
                            found.add((j, d))
                        upto[d] = j
                if path and met < long:
                    d = j - path[-1][1]
                    if long >= times * d and long + d >= LEAST:
                        if upto.get(d, -2) != j - 1:
                            found.add((j, d))
                        upto[d] = j
                path.append((long, j))
            v = link[top]
    return found


def runs_in(words: list[int], first: int, end: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs found among the places from first to end, by start, then period."""
    made: dict[tuple[int, int], int] = {}
    seen: dict[int, list[tuple[int, int]]] = {}
    for j, d in sorted(repeats(words[first:end])):
        j += first
        if any(a <= j < b for a, b in seen.get(d, ())):
            continue
        a, b = j - TIMES * d + 1 if d > 1 else j - LEAST + 1, j + 1
        while a > 0 and words[a - 1] == words[a - 1 + d]:
            a -= 1
        while b < len(words) and words[b] == words[b - d]:
            b += 1
        seen.setdefault(d, []).append((a, b))
        made[a, b] = min(d, made.get((a, b), d))
    return sorted((a, b - a, d) for (a, b), d in made.items() if b - a >= max(LEAST, TIMES * d))


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length over period; ties: smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_runs; start, length, period and exponent_milli of the run of greatest exponent; runs; and collapsed, the words that no run repeats, joined by one space."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = raw(batch.column(text))
            ids, bounds = words_of(texts)
            runs: dict[int, list] = {}
            whole: dict[int, list[int]] = {}
            for t, first, end in stretches(ids, bounds):
                if t not in whole:
                    whole[t] = ids[bounds[t] : bounds[t + 1]].tolist()
                runs.setdefault(t, []).extend(runs_in(whole[t], first, end))
            made, tops, left = [], [], []
            for t, x in enumerate(texts):
                words, mine = x.split(), sorted(set(runs.get(t, ())), key=lambda r: (r[0], r[2]))
                if mine:
                    drop = np.zeros(len(words), bool)
                    for start, length, period in mine:
                        drop[start + period : start + length] = True
                    words = [w for w, gone in zip(words, drop.tolist()) if not gone]
                best = greatest(mine) if mine else None
                made.append(mine)
                tops.append((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
                left.append(b" ".join(words))
            flat = [r for rs in made for r in rs]
            parts = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in _RUN.fields])
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(rs) for rs in made])].astype(np.int32)), parts, type=pa.list_(pa.field("element", parts.type, False)))
            return [pa.array([len(rs) for rs in made], pa.int64()), *[pa.array([x[i] for x in tops], pa.int64()) for i in range(4)], listed, pa.array(left, pa.binary()).cast(pa.string())]

        return run

    return append(docs, _FIELDS, make, text)


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which the last words of one text in ten repeat with a period, by its id. Texts under a null id stay as they are."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for key, x in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                h = zlib.crc32(str(key).encode())
                if key is not None and h % 10 == 0 and (words := x.split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    x = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
                out.append(x)
            return [pa.array(out, pa.binary()).cast(pa.string())]

        return run

    return append(docs, [T.StructField("made", T.StringType())], make, "text").select("doc_id", F.col("made").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.col("n_runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

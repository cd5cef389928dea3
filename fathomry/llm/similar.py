"""Groups of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more: SimHash, then an exact rest.

Fingerprints (see simhash.py) that link, and equal ones, give the first candidates; those that hold join the documents into
groups. 64 bits are too few for a similarity of 0.8 (two such documents differ in about 10 bits), so a second search loses
none of the others: two sets that similar share a shingle among the first n - ceil(4n / 5) + 1 of each, in any one order of all
shingles (prefix filter). Shingles that some of the documents have often come last, so a passage found in many documents makes
few candidates. A bucket's rows are compared by their sizes and by a bitmap of each set (the bits in which two differ are at
most as many as the shingles in which they do, so no similar pair is lost) and by the places of the bucket's shingle in
their orders, which bound what they can have in common; what passes is verified by the whole sets. Each row
first sends the likeliest of some others of its bucket, and then all that are not in its group by now, so a large group of near
copies costs few pairs.

Equal sets are one vertex from the start. A bucket of more than `BLOCK` rows is dealt over several tasks, two blocks to each.
Shingles are compared by 64-bit hashes. Defined results: a null text counts as empty, and texts without words have equal
(empty) sets; equal rows are in one group, and of a group the least id stands for it; texts may be of any length; columns
other than the id and the text are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, pieces, raw, written
from .components import components
from .simhash import bits_of, hashes, links, plan

BLOCK = 16_384
#: One document in so many is asked for common shingles; at most how many of them, the most frequent, are kept.
EVERY, COMMON = 8, 1 << 20
#: Bits of a small set's bitmap, and rows of a bucket among which each row first looks for the likeliest.
MAP, AMONG = 512, 64
#: A bucket up to which rows are compared step by step for many buckets at once.
SMALL = 128


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(hashes(text, size))


def vertex(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 43)).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _sets(docs: DataFrame, size: int, emit, schema: str) -> DataFrame:
    """emit(v, hashes) -> list of columns, for each set once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = raw(batch.column(0))
            for a, b in pieces([len(x) for x in texts]):
                rows = []
                for text in texts[a:b]:
                    h = shingle_set(text, size)
                    v = vertex(h)
                    if len(h) and v not in seen:
                        seen.add(v)
                        rows.append(emit(v, h))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("text").mapInArrow(run, schema)


def common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more documents of one in EVERY, sorted, and in how many of them each is; at most COMMON. They decide in what order shingles are taken, not what is found."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0)
    found = written(_sets(some, size, lambda v, h: [h.view(np.int64)], "k long").groupBy("k").count().where("count > 1"), "common")
    least, total = 2, 0
    for r in found.groupBy(F.least("count", F.lit(10_000)).alias("c")).count().orderBy(F.desc("c")).collect():  # 10,000 rows at most
        total += r["count"]
        if total > COMMON:
            least = r["c"] + 1
            break
    kept = found.where(F.col("count") >= least).toArrow()
    k, n = kept["k"].to_numpy().view(np.uint64), kept["count"].to_numpy()
    order = np.argsort(k)
    return k[order], np.minimum(n[order], 60_000).astype(np.uint16)


def postings(docs: DataFrame, size: int) -> DataFrame:
    """k, v, n, place: each set (v, of n shingles) under the shingles of its prefix, the rarest first, with their places in it."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs, size))

    def emit(v: int, h: np.ndarray) -> list[np.ndarray]:
        n = len(h)
        often, count = shared.value
        known = np.zeros(n, np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, h), len(often) - 1)
            known = np.where(often[at] == h, count[at], 0)
        order = h[np.argsort(known, kind="stable")]
        k = order[: n - (4 * n + 4) // 5 + 1].view(np.int64)
        return [k, np.full(len(k), v, np.int64), np.full(len(k), n, np.int32), np.arange(len(k), dtype=np.int32)]

    return _sets(docs, size, emit, "k long, v long, n int, place int")


def bitmap(h: np.ndarray) -> bytes:
    """For each bit, whether an odd number of the distinct hashes fall on it: a power of two times MAP bits, as many as hashes or more."""
    bits = MAP << max(0, (len(h) - 1) // MAP).bit_length()
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


@dataclass
class Rows:
    """Rows of buckets: run (number of the bucket, ascending), vertex, size of the set, place of the bucket's shingle in it, root; and of each length of bitmaps (as 64-bit words), which row of its matrix is a row's."""

    run: np.ndarray
    v: np.ndarray
    n: np.ndarray
    place: np.ndarray
    root: np.ndarray
    length: np.ndarray
    at: dict[int, np.ndarray]
    words: dict[int, np.ndarray]

    @classmethod
    def made(cls, run: np.ndarray, v: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, bits: list[bytes]) -> Rows:
        length = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        at, words = {}, {}
        for size in np.unique(length).tolist():
            own, twice = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
            wide = np.frombuffer(b"".join(bits[i] for i in twice.tolist()), np.uint64).reshape(-1, 2 * size)
            # a longer bitmap folds to a shorter one
            words[size] = np.concatenate([np.frombuffer(b"".join(bits[i] for i in own.tolist()), np.uint64).reshape(-1, size), wide[:, :size] ^ wide[:, size:]])
            at[size] = np.zeros(len(bits), np.int64)
            at[size][np.append(own, twice)] = np.arange(len(words[size]))
        return cls(run, v, n, place, root, length, at, words)

    def of(self, rows) -> Rows:
        return Rows(self.run[rows], self.v[rows], self.n[rows], self.place[rows], self.root[rows], self.length[rows], {k: x[rows] for k, x in self.at.items()}, self.words)

    def slack(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By how many bits each pair's bitmaps may differ more before it cannot be alike (9 * differing shingles <= both sizes); under 0 for a pair that is not, or has one root."""
        can = (self.root[a] != self.root[b]) & (5 * np.minimum(self.n[a], self.n[b]) >= 4 * np.maximum(self.n[a], self.n[b]))
        # if this is the first shingle that both have, they have no more in common than what follows it; if not, they meet in an earlier one's bucket
        can &= 9 * np.minimum(self.n[a] - self.place[a], self.n[b] - self.place[b]) >= 4 * (self.n[a] + self.n[b])
        out = np.full(len(a), -1, np.int64)
        can = np.flatnonzero(can)
        short = np.minimum(self.length[a[can]], self.length[b[can]])
        for size in np.unique(short).tolist():
            pairs = can[short == size]
            x, y = a[pairs], b[pairs]
            words, at = self.words[size], self.at[size]
            out[pairs] = (self.n[x] + self.n[y]) // 9 - np.bitwise_count(words[at[x]] ^ words[at[y]]).sum(axis=1, dtype=np.int64)
        return out


def _likeliest(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the likeliest of the AMONG after it."""
    m = len(rows.v)
    best, partner = np.full(m, -1, np.int64), np.zeros(m, np.int64)
    for step in range(1, AMONG + 1):
        at = np.flatnonzero(rows.run[step:] == rows.run[:-step]) if step < m else np.zeros(0, np.int64)
        if not len(at):
            break
        for one, other in ((at, at + step), (at + step, at)):
            slack = rows.slack(one, other)
            better = slack > best[one]
            best[one[better]], partner[one[better]] = slack[better], other[better]
    found = np.flatnonzero(best >= 0)
    return rows.v[found], rows.v[partner[found]]


def _all(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a run that can be alike: step by step in small runs; in a large one those outside its largest group meet all others."""
    starts = np.flatnonzero(np.append(True, rows.run[1:] != rows.run[:-1]))
    sizes = np.diff(np.append(starts, len(rows.v)))
    mixed = np.minimum.reduceat(rows.root, starts) != np.maximum.reduceat(rows.root, starts)
    small = rows.of(np.repeat(mixed & (sizes <= SMALL), sizes))
    for step in range(1, SMALL):
        at = np.flatnonzero(small.run[step:] == small.run[:-step]) if step < len(small.v) else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[small.slack(at, at + step) >= 0]
        yield small.v[at], small.v[at + step]
    for k in np.flatnonzero(mixed & (sizes > SMALL)).tolist():
        large = rows.of(slice(starts[k], starts[k] + sizes[k]))
        of, counts = np.unique(large.root, return_inverse=True, return_counts=True)[1:]
        outside = of != counts.argmax()
        every = np.arange(len(of))
        for i in np.flatnonzero(outside).tolist():
            other = every[~outside | (every > i)]
            other = other[large.slack(np.full(len(other), i), other) >= 0]
            yield np.full(len(other), large.v[i]), large.v[other]


def _candidates(rows: DataFrame, every: bool) -> DataFrame:
    """(a, b), a > b: rows of one bucket and of different roots that can be alike; every: all of them, else the likeliest of each. rows: k, tile, v, n, place, root, bits."""
    # one order in all buckets, so that a row meets the same others in many of them and is asked for the same pairs
    rows = rows.select("k", "tile", F.xxhash64("v").alias("at"), "v", "n", "place", "root", "bits")

    def batch_of(made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([m[i] for m in made]) for i in (0, 1))
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            k, tile = table["k"].to_numpy(), table["tile"].to_numpy()
            new = np.append(True, (k[1:] != k[:-1]) | (tile[1:] != tile[:-1]))
            stop = len(k) if final else int(np.flatnonzero(new)[-1])
            held[:] = table.slice(stop).to_batches()
            if not stop:
                return
            table = table.slice(0, stop)
            here = Rows.made(np.cumsum(new[:stop]), table["v"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["place"].to_numpy().astype(np.int64), table["root"].to_numpy(), table["bits"].to_pylist())
            made: list[tuple[np.ndarray, np.ndarray]] = []
            for pair in _all(here) if every else [_likeliest(here)]:
                made.append(pair)
                if sum(len(x) for x, _ in made) > 100_000:
                    yield batch_of(made)
                    made = []
            if made:
                yield batch_of(made)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > 20_000:
                yield from cut(False)
        if held:
            yield from cut(True)

    return rows.repartition("k", "tile").sortWithinPartitions("k", "tile", "at").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(v: int, text: bytes) -> np.ndarray:
            if v not in known:
                if len(known) > 500:
                    known.clear()
                known[v] = shingle_set(text, size)
            return known[v]

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), raw(batch.column(3)))
            yield batch.filter(pa.array([alike(of(a, x), of(b, y)) for a, b, x, y in rows], pa.bool_())).select(["a", "b"])

    sides = [texts.select(F.col("v").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def by_fingerprints(sets: DataFrame, most: int) -> DataFrame:
    """(a, b), a > b: sets (v, fp) with one fingerprint, tied to the least of them, and the least ones of fingerprints that link."""
    least = written(sets.groupBy("fp").agg(F.min("v").alias("m")), "fingerprints")
    bare = least.select("fp")
    found = links(bare, plan(bare, most), most)
    ends = [least.select(F.col("fp").alias(c), F.col("m").alias(f"m_{c}")) for c in "ab"]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.col("m_a").alias("x"), F.col("m_b").alias("y"))
    inside = sets.join(least, "fp").where("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y"))
    return inside.union(across).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """v, text of the sets in pairs, each from one document. Only wanted ids meet the texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(sets.select("v", "first"), "v")
    wanted = written(wanted.select("v", F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th")), "wanted")
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["th"] == F.col("__th"))).select("v", F.col("text").cast("binary").alias("text"))
    return written(found.dropDuplicates(["v"]), "texts")


def groups(docs: DataFrame, sets: DataFrame, size: int, most: int) -> DataFrame:
    """v, root: each set that is alike others and is not the least of its group, with that least one. docs: doc_id, th, text, a written table, as it is read several times; sets: their distinct (v, fp, bits, first), first being the doc_id and th of one of them."""
    rows = written(postings(docs, size), "prefixes")
    often = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    # each two blocks of a large bucket meet in one tile
    mine = F.pmod(F.xxhash64("v", F.lit(7)), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))
    shared = rows.join(often, "k").select("k", "v", "n", "place", F.explode(tiles).alias("tile")).join(sets.select("v", "bits"), "v")
    shared = written(shared, "postings")
    found, pairs = None, written(by_fingerprints(sets.select("v", "fp"), most), "candidates")
    for every in (False, True, None):
        links_ = written(_verified(pairs, _texts(docs, sets, pairs), size), "links")
        found = links_ if found is None else found.union(links_)
        roots = components(found).select(F.col("a").alias("v"), F.col("b").alias("root"))
        if every is not None:
            now = shared.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
            pairs = written(_candidates(now, every), "candidates")
    return roots


def similar(docs: DataFrame, doc_id: str = "doc_id", *, size: int = 5, most: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), root (the group) and component_id: the least id that a chain of documents with a similarity of 0.8 or more reaches. docs should be a written table; most: bits by which fingerprints link."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            made = [hashes(x, size) for x in raw(batch.column("text"))]
            sets = [np.unique(h) for h in made]
            fps = np.array([bits_of(h) for h in made], np.uint64).view(np.int64)
            return [pa.array(list(map(vertex, sets)), pa.int64()), pa.array(fps, pa.int64()), pa.array(list(map(bitmap, sets)), pa.binary())]

        return run

    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    marked = written(append(docs, [T.StructField("v", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType())], make, "text").drop("text"), "sets")
    first = F.min(F.struct("doc_id", "th")).alias("first")
    sets = written(marked.groupBy("v").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("bits").alias("bits"), first), "vertices")
    labels = sets.join(groups(docs, sets, size, most), "v", "left").withColumn("root", F.coalesce("root", "v"))
    labels = written(labels.select("v", "id", "root"), "labels")
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    return marked.join(labels.join(least, "root").select("v", "root", "component_id"), "v").select(F.col("doc_id").alias(doc_id), "th", "root", "component_id")

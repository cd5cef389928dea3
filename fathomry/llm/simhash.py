"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints within `most` bits of each other must, for any split of the bits into m parts with thresholds that add up to
most - m + 1, be within some part's threshold on that part (a threshold of -1 leaves a part out). Correlated bits are put
in the same part. For each m a dynamic programme gives each part a threshold so that the estimated number of candidates and
probes is least; the cheapest m is used. A part of threshold t is probed with all keys that differ in at most t of its bits.

Equal fingerprints are one vertex from the start, so a group of copies of any size is one row here. Probes that meet in a
bucket are verified in NumPy blocks, and a bucket sends on only links that join two trees it has not joined yet, so at most
one link for each of its rows: components stay whole while no task emits a group's pairs. A bucket of more than `BLOCK` rows
is dealt over several tasks, two of its blocks to each.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; equal rows
have equal results; rows with a null id keep their fingerprint, and their component is the least id reachable, or null; rows
with equal ids are linked by their own texts; texts may be of any length (a task holds some 2 MB of them, or one text); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, kept, raw, scratch, small_batches, table, without, written
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = 64
BLOCK = 4096
#: Cost of making and sorting one probe, in verified pairs.
PROBE_COST = 40.0


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    parts = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in parts), np.uint64, len(parts))


def bits_of(h: np.ndarray) -> int:
    """The fingerprint: a bit is set where over half of the hashes have it."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        votes += np.unpackbits(h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    return np.array([bits_of(hashes(x, size)) for x in texts], np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", *, size: int = 3) -> DataFrame:
    """docs with fp, the fingerprint as a signed long."""

    def make():
        return lambda batch: [pa.array(fingerprints(raw(batch.column(text)), size).view(np.int64), pa.int64())]

    return append(docs, [T.StructField("fp", T.LongType())], make, text)


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def correlation(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, share of ones of each bit, and absolute correlation of each two bits, over all fingerprints: 64 x 64 sums are all that leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(x), 100_000):
                bits = np.unpackbits(np.ascontiguousarray(x[k : k + 100_000]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                gram += bits.T @ bits
                n += len(bits)
        at = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(gram.ravel(), n), pa.float64())], names=["at", "v"])

    rows = fps.select("fp").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # 4,097 rows
    found = {r["at"]: r["v"] for r in rows}
    n = int(found.get(-1, 0))
    gram = np.array([found.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS) / max(n, 1)
    share = np.diag(gram).copy()
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    return n, share, np.abs(np.divide(gram - np.outer(share, share), scale, out=np.zeros_like(gram), where=scale > 0))


def group_bits(corr: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m parts of nearly equal size; each grows from the free bit of most correlation by the bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        rest = sorted(free)
        part = [max(rest, key=lambda i: (corr[i, rest].sum() - corr[i, i], -i))]
        while len(part) < size:
            part.append(max(sorted(free - {*part}), key=lambda i: corr[i, part].sum()))
        free -= {*part}
        parts.append(tuple(sorted(part)))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on, one for each part, that add up to total at the least summed cost; costs[i][t + 1] is that of part i with threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if done + t not in step or cost + c < step[done + t][0]:
                    step[done + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def key(bits: tuple[int, ...], fp: str = "fp") -> Column:
    """The bits of a part, as a long."""
    mask = sum(1 << b for b in bits)
    return F.col(fp).bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long"))


def plan(fps: DataFrame, most: int = 3, widest: int = 4) -> list[Part]:
    """Parts and thresholds for these distinct fingerprints. Pairs that agree on a part are counted over all of them; those that differ in few of its bits are estimated from the share of ones of each bit."""
    n, share, corr = correlation(fps)
    grouped = {m: group_bits(corr, m) for m in range(2, widest + 1)}
    flat = [bits for m in grouped for bits in grouped[m]]
    keys = fps.select(F.posexplode(F.array(*[key(b) for b in flat])).alias("part", "k"))
    same = {r["part"]: float(r["pairs"]) for r in keys.groupBy("part", "k").count().groupBy("part").agg((F.sum((F.col("count") * (F.col("count") - 1)).cast("double")) / 2).alias("pairs")).collect()}
    agree = share**2 + (1 - share) ** 2
    plans, k = [], 0
    for m, parts in grouped.items():
        costs = []
        for bits in parts:
            odds = [1.0]  # odds[t]: how often a pair differs in just t of these bits, against in none
            for b in bits:
                q = (1 - agree[b]) / agree[b]
                odds = [x + (odds[t - 1] * q if t else 0) for t, x in enumerate([*odds, 0.0])][: most + 1]
            row, probes = [0.0], 0.0
            for t in range(most + 1):
                probes += _choose(len(bits), t)
                row.append(max(same.get(k, 0.0), n * n / 2.0 ** (len(bits) + 1)) * sum(odds[: t + 1]) + PROBE_COST * n * probes)
            costs.append(row)
            k += 1
        cost, chosen = allocate(costs, most - m + 1)
        plans.append((cost, [Part(b, t) for b, t in zip(parts, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _flips(bits: tuple[int, ...], t: int) -> list[int]:
    """Masks, as signed longs, of one to t of these bits."""
    masks = {0}
    for _ in range(t):
        masks |= {m ^ (1 << b) for m in masks for b in bits if not m >> b & 1}
    return sorted(m - (m >> 63 << 64) for m in masks - {0})


def probes(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """part, k, fp, asks: each fingerprint under its key in every part, and, asking, under the keys that part's threshold reaches."""

    def row(i: int, k: Column, asks: bool) -> Column:
        return F.struct(F.lit(i).alias("part"), k.alias("k"), F.lit(asks).alias("asks"))

    def reached(i: int, p: Part) -> Column:
        return F.transform(F.array(*[F.lit(m) for m in _flips(p.bits, p.threshold)]), lambda m: row(i, key(p.bits).bitwiseXOR(m), True))

    rows = [F.array(row(i, key(p.bits), False)) for i, p in enumerate(parts)]
    rows += [reached(i, p) for i, p in enumerate(parts) if p.threshold]
    return fps.select("fp", F.explode(F.concat(*rows)).alias("p")).select("p.part", "p.k", "fp", "p.asks")


def _links(fp: np.ndarray, asks: np.ndarray, run: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the verified links inside each run of equal keys; run: number of each row's run, ascending."""
    out: list[tuple[int, int]] = []
    bits = fp.view(np.uint64)  # counting the ones of signed numbers would drop their sign
    begins = np.searchsorted(run, np.arange(run[-1] + 2) if len(run) else [])
    tree = np.arange(len(fp))  # each row's tree, by the number of one of its rows
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            return out
        other = at + step
        near = (tree[at] != tree[other]) & (np.bitwise_count(bits[at] ^ bits[other]) <= most) & ~(asks[at] & asks[other])
        for i, j in zip(at[near].tolist(), other[near].tolist()):
            old, new = tree[i], tree[j]
            if old != new:
                rows = tree[begins[run[i]] : begins[run[i] + 1]]
                rows[rows == old] = new
                a, b = int(fp[i]), int(fp[j])
                out.append((max(a, b), min(a, b)))
        step += 1


def links(fps: DataFrame, parts: list[Part], most: int = 3) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints that have the same components as all links."""
    rows = probes(fps, parts)
    large = rows.groupBy("part", "k").count().where(F.col("count") > BLOCK)
    large = written(large.select("part", "k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    dealt = rows.join(large, ["part", "k"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # each two blocks of a large bucket meet in one tile
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))
    order = ["part", "k", "tile"]
    dealt = dealt.select("part", "k", "fp", "asks", F.explode(tiles).alias("tile")).select(*order, "fp", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def cut(final: bool) -> pa.RecordBatch:
            part, k, tile, fp, asks = cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
            new = np.ones(len(fp), bool)
            new[1:] = (part[1:] != part[:-1]) | (k[1:] != k[:-1]) | (tile[1:] != tile[:-1])
            end = len(fp) if final else int(np.flatnonzero(new)[-1])
            held[:] = [[c[end:] for c in cols]]
            pairs = _links(fp[:end], asks[:end], np.cumsum(new[:end]) - 1, most)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            if sum(len(h[0]) for h in held) > 50_000:
                yield cut(False)
        if held:
            yield cut(True)

    return dealt.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(marked: DataFrame, doc_id: str = "doc_id", *, most: int = 3) -> DataFrame:
    """marked (doc_id, fp, ...) with component_id, the least id that links reach. marked should be a written table: it is read twice."""
    fps = written(marked.groupBy("fp").agg(F.min(doc_id).alias("id")), "fingerprints")
    bare = fps.select("fp")
    stars = components(links(bare, plan(bare, most), most))
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    labels = fps.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    named = labels.join(least, "root").select("fp", "component_id")
    return without(marked, "component_id").join(named, "fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = written(fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "simhash")
    return near_duplicates(marked).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a similarity of 0.8 or more (five-word shingles), that of the least id (then of the least hash of its text; null ids last): SimHash candidates, and those that 64 bits miss (see similar.py)."""
    from .similar import similar

    with scratch(), small_batches(spark):
        each = similar(docs).groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
        one = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rows")).alias("m"))
        one = kept(one.select(F.col("m.doc_id").alias("__id"), F.col("m.th").alias("__th"), F.col("m.rows").alias("__rows")), "kept")
    mine = [F.col(f"`{c}`") for c in docs.columns]
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__th"))
    once = docs.join(one.where("__rows = 1"), same).select(*mine)
    # equal rows, of which one stays
    often = docs.join(one.where("__rows > 1"), same).dropDuplicates(["__id", "__th"]).select(*mine)
    return once.union(often)

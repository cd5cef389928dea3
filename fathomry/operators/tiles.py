"""All pairs of two vector tables as products of packed blocks (J7, J8, J10, J12, O4, O5 on their scale path).

Rows of both sides are packed where they are read: a row of the shuffle is a piece of a block, with ids in one array and vectors in
one byte string (four bytes a number where that loses nothing). Only pieces are copied to the blocks of the other side, so a side
is sent as often as the other has blocks, and a block has as many rows as `BYTES` hold. A task multiplies two blocks, part by part,
and a fold takes each part of the product: the k best, a sum, whether any is near. Pairs become rows only where a fold makes them.

`keys` restricts pairs to equal keys (classes). Blocks are counted for each key, a large class having many; small ones are packed
together in blocks of their own, and parted again inside the task. Nothing of the size of a side is broadcast or collected.

Products only select: what lies within rounding of a limit is reckoned again from differences or plain sums, so equal vectors have
distance zero and equal scores, and results do not depend on the blocks. Rows without a vector have no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a block's vectors; of vectors that a task packs at once; scores held at once; rows of a block, so that a task's pairs are bounded;
#: the same where pairs become rows; the fewest pairs that are sorted (few have no equal values); rows that a task hands on at once.
BYTES, PACK, SCORES, ROWS, PAIRS, SORTED, BATCH = 32 << 20, 64 << 20, 4_000_000, 1 << 14, 2400, 1 << 19, 1 << 18


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if n else np.zeros(0)
    return flat.astype(np.float64).reshape(n, -1)


class Side:
    """Rows of one side of a tile: ids (ascending), vectors, and further columns by name."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, more: dict[str, pa.Array], metric: str) -> None:
        self.ids, self.more = ids, more
        self.x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cos" else x
        self.norms = np.einsum("ij,ij->i", self.x, self.x)

    def part(self, a: int, b: int) -> Side:
        out = object.__new__(Side)
        out.ids, out.x, out.norms, out.more = self.ids[a:b], self.x[a:b], self.norms[a:b], {k: v.slice(a, b - a) for k, v in self.more.items()}
        return out


def products(a: Side, b: Side, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores (larger is nearer: negated squared distance, dot product or cosine), and for each row of a by how much they may be off."""
    dots = a.x @ b.x.T
    eps, top = 4 * (a.x.shape[1] + 4) * np.finfo(float).eps, b.norms.max(initial=0.0)
    if metric == "l2":
        dots *= 2
        dots -= a.norms[:, None]
        dots -= b.norms
        return dots, eps * (a.norms + top)
    return dots, eps * np.sqrt(a.norms * top)


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of paired rows; equal rows score alike wherever they stand."""
    if metric == "l2":
        a = a - b
        return -np.einsum("ij,ij->i", a, a)
    return np.einsum("ij,ij->i", a, b)


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All scores of two small matrices."""
    sides = (Side(np.arange(len(x)), x, {}, metric) for x in (a, b))
    return products(*sides, metric)[0]


def _own(keys: list[str]) -> list[str]:
    return [f"__own{i}" for i in range(len(keys))]


def _packed(rows: DataFrame, keys: list[str], more: list[str], other: str, mine: str) -> DataFrame:
    """Pieces of blocks, one row each, copied to each of the other side's blocks."""
    group = ["__bin", *_own(keys), mine, "__n"]
    listed = [*keys, "id", *more]
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*[T.StructField(g, kinds[g]) for g in group], *[T.StructField(c, T.ArrayType(kinds[c])) for c in listed], T.StructField("wide", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def pieces(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables).combine_chunks()
        x = _matrix(t.column("x"))
        small = x.astype(np.float32)
        wide = bool((small != x).any())
        data = np.ascontiguousarray(x if wide else small)
        t = t.drop_columns(["x"]).append_column("__at", pa.array(np.arange(len(x))))
        made = t.group_by(group, use_threads=False).aggregate([*[(c, "list") for c in listed], ("__at", "list")])
        for batch in made.combine_chunks().to_batches():
            places = batch.column("__at_list")
            vectors = pa.array([data[p.values.to_numpy()].tobytes() for p in places], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(g) for g in group], *[batch.column(f"{c}_list") for c in listed], pa.array([wide] * batch.num_rows), vectors], names=schema.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.nbytes
            if size > PACK:
                yield from pieces(held)
                held, size = [], 0
        if held:
            yield from pieces(held)

    out = rows.select(*group, *listed, "x").mapInArrow(pack, schema)
    return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))


def _dealt(queries: DataFrame, bank: DataFrame, keys: list[str], block: int | None, sized: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with __bin, own keys, their block, and the number of the other's blocks."""
    known = bank if sized is None else sized
    dim = (known.select(F.size("x").alias("d")).first() or [1])[0]
    spark = queries.sparkSession
    if not keys:
        n_q, n_b = queries.count(), known.count()
        # no larger than BYTES allow, no larger than keeps all cores at work, and not so small that copies outweigh that
        rows = block or max(1, min(ROWS, BYTES // (8 * max(1, dim)), max(1024, math.isqrt(n_q * n_b // (2 * spark.sparkContext.defaultParallelism)))))
        counts = [max(1, -(-n // rows)) for n in (n_q, n_b)]
        return tuple(df.withColumns({"__bin": F.lit(0), own: F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(mine)).cast("int"), "__n": F.lit(other)}) for df, own, mine, other in ((queries, "__q", *counts), (bank, "__b", *reversed(counts))))
    rows = block or max(1, BYTES // (8 * max(1, dim)))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    q, b = (df.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(F.count(F.lit(1)).alias(c)) for df, c in ((queries, "__nq"), (known, "__nb")))
    same = [F.col(f"q.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names.values()]
    both = q.alias("q").join(b.alias("b"), same).select(*[F.col(f"q.{n}").alias(n) for n in names.values()], "__nq", "__nb")
    large = F.greatest("__nq", "__nb") > max(1, rows // 8)
    total = both.agg(F.sum(F.when(~large, F.greatest("__nq", "__nb")))).first()[0] or 0
    bins = max(1, -(-total // rows) if block else min(total // 1024 + 1, max(-(-total // rows), 2 * spark.sparkContext.defaultParallelism)))
    split = {c: F.when(large, F.ceil(F.col(n) / min(rows, block or ROWS))).otherwise(1).cast("int") for c, n in (("__bq", "__nq"), ("__bb", "__nb"))}
    both = both.select(*names.values(), F.when(large, -1).otherwise(F.pmod(F.xxhash64(F.lit(5), *names.values()), F.lit(bins))).cast("int").alias("__bin"), *[v.alias(k) for k, v in split.items()])

    def side(df: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        met = df.join(both, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        mine_ = {o: F.when(F.col("__bin") < 0, F.col(k)) for o, k in zip(_own(keys), keys)}
        return met.withColumns({**mine_, own: F.pmod(F.xxhash64(F.lit(3), "id"), F.col(mine)).cast("int"), "__n": F.col(other)}).drop(*names.values(), "__bq", "__bb")

    return side(queries, "__q", "__bq", "__bb"), side(bank, "__b", "__bb", "__bq")


def _read(t: pa.Table, keys: list[str], more: list[str], metric: str) -> tuple[Side, list[pa.Array]]:
    """A block's rows by ascending id, and their keys."""
    columns = {c: pa.concat_arrays([x.flatten() for x in t.column(c).chunks]) for c in ["id", *keys, *more]}
    n = len(columns["id"])
    sizes = pc.list_value_length(t.column("id")).to_pylist()
    x = np.concatenate([np.frombuffer(v.as_buffer(), np.float64 if w else np.float32).reshape(k, -1) for v, w, k in zip(t.column("x"), t.column("wide").to_pylist(), sizes)]).astype(np.float64) if n else np.zeros((0, 0))
    order = pc.array_sort_indices(columns["id"])
    columns = {c: v.take(order) for c, v in columns.items()}
    side = Side(columns["id"].to_numpy(zero_copy_only=False), x[order.to_numpy()], {c: columns[c] for c in more}, metric)
    return side, [columns[k] for k in keys]


def _codes(left: list[pa.Array], right: list[pa.Array], n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each row's keys, equal for equal keys."""
    out = np.zeros(n + m, np.int64)
    for a, b in zip(left, right):
        c = pc.dictionary_encode(pa.concat_arrays([a, b]), null_encoding="encode").indices.to_numpy()
        out = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
    return out[:n], out[n:]


def tiles(queries: DataFrame, bank: DataFrame, fold: Callable[[Side], object], fields: list[T.StructField], *, metric: str, keys: tuple[str, ...] = (), more: tuple[list[str], list[str]] = ([], []), block: int | None = None, sized: DataFrame | None = None, held: int = SCORES) -> DataFrame:
    """keys and fields: what folds make of each pair of blocks with equal keys. fold(left) makes one; its add(scores, off, left part, its first row, right part) is called for each part of the product, and told() gives (rows of left, arrays of fields). Both sides: keys, id, x and what more names. block: rows of a block at most. sized: a table with as many rows of each key as the bank, where that is cheaper to count. held: scores held at once."""
    keys = list(keys)
    left_more, right_more = more
    queries = queries.select(*keys, "id", "x", *left_more).where(F.col("x").isNotNull())
    bank = bank.select(*[F.col(c).alias(c) for c in (*keys, "id", "x", *right_more)]).where(F.col("x").isNotNull())  # both sides may be one table
    heads = [queries.schema[k] for k in keys]
    schema = T.StructType([*heads, *fields])
    arrow = to_arrow_schema(schema)
    left, right = _dealt(queries, bank, keys, block, sized)
    group = ["__bin", *_own(keys), "__q", "__b"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            (qs, qk), (bs, bk) = _read(a, keys, left_more, metric), _read(b, keys, right_more, metric)
            mine, other = _codes(qk, bk, len(qs.ids), len(bs.ids))
            q_order, b_order = np.argsort(mine, kind="stable"), np.argsort(other, kind="stable")
            if keys:
                qs.ids, qs.x, qs.norms, qs.more, qk = qs.ids[q_order], qs.x[q_order], qs.norms[q_order], {k: v.take(pa.array(q_order)) for k, v in qs.more.items()}, [k.take(pa.array(q_order)) for k in qk]
                bs.ids, bs.x, bs.norms, bs.more = bs.ids[b_order], bs.x[b_order], bs.norms[b_order], {k: v.take(pa.array(b_order)) for k, v in bs.more.items()}
                mine, other = mine[q_order], other[b_order]
            for code in np.intersect1d(mine, other):
                i, j = np.searchsorted(mine, [code, code + 1])
                k, l = np.searchsorted(other, [code, code + 1])
                q, v = qs.part(i, j), bs.part(k, l)
                made = fold(q)
                wide = min(l - k, held)
                tall = max(1, held // wide)
                for r in range(0, j - i, tall):
                    some = q.part(r, r + tall)
                    for c in range(0, l - k, wide):
                        near = v.part(c, c + wide)
                        made.add(*products(some, near, metric), some, r, near)
                rows, arrays = made.told()
                out.append(pa.Table.from_arrays([*[x.slice(i, j - i).take(pa.array(rows)) for x in qk], *[pa.array(x, t) for x, t in zip(arrays, arrow.types[len(keys) :])]], schema=arrow))
        return pa.Table.from_batches([b for t in out for b in t.to_batches(BATCH)], arrow)

    pairs = _packed(left, keys, left_more, "__b", "__q").groupBy(*group).cogroup(_packed(right, keys, right_more, "__q", "__b").groupBy(*group))
    return pairs.applyInArrow(run, schema)


class _Best:
    """The k best of the bank for each query; ties go to the lesser id."""

    def __init__(self, left: Side, k: int, metric: str, carried: list[str]) -> None:
        self.n, self.k, self.metric, self.carried = len(left.ids), k, metric, carried
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, s: np.ndarray, off: np.ndarray, left: Side, first: int, right: Side) -> None:
        k = min(self.k, s.shape[1])
        limit = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * off
        rows, cols = np.nonzero(s >= limit[:, None])
        real = exact(left.x[rows], right.x[cols], self.metric)
        keep = _first(rows, real, right.ids[cols], self.k)
        rows, cols, real = rows[keep], cols[keep], real[keep]
        self.found.append((rows + first, left.ids[rows], right.ids[cols], real, *[right.more[c].take(pa.array(cols)).to_pylist() for c in self.carried]))

    def told(self) -> tuple[np.ndarray, list]:
        rows, ids, near, s, *rest = (np.concatenate([np.asarray(f[i], object if i > 3 else None) for f in self.found]) for i in range(4 + len(self.carried)))
        keep = _first(rows, s, near, self.k)
        return rows[keep], [ids[keep], near[keep], s[keep], *[x[keep].tolist() for x in rest]]


def _first(rows: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of the k largest s; ties go to the lesser id."""
    order = np.lexsort((ids, -s, rows))
    ranked = rows[order]
    start = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    at = np.arange(len(ranked))
    return order[at - np.maximum.accumulate(np.where(start, at, 0)) < k]


def nearest(queries: DataFrame, bank: DataFrame, k: int, *, metric: str = "l2", keys: tuple[str, ...] = (), carried: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """keys, id, neighbour, score, carried columns of the bank, place (from 1): the k best of the bank for each query; ties go to the lesser id. Both sides: keys, id, x."""
    fields = [T.StructField("id", queries.schema["id"].dataType), T.StructField("neighbour", bank.schema["id"].dataType), T.StructField("score", T.DoubleType()), *[bank.schema[c] for c in carried]]
    found = tiles(queries, bank, lambda left: _Best(left, k, metric, list(carried)), fields, metric=metric, keys=keys, more=([], list(carried)), block=block)
    place = F.row_number().over(W.partitionBy(*keys, "id").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


class _Pairs:
    """Every pair as a row. Those of equal values in a large part of the product lie together, so files keep a value once for them all."""

    def __init__(self, left: Side, metric: str, value: Callable[[np.ndarray], np.ndarray] | None) -> None:
        self.metric, self.value, self.found = metric, value, []

    def add(self, s: np.ndarray, off: np.ndarray, left: Side, first: int, right: Side) -> None:
        real, wide = s.ravel(), np.uint32(s.shape[1])
        if self.metric == "l2":  # equal vectors have no distance
            close = np.flatnonzero(s >= -2 * off[:, None])
            rows, cols = np.divmod(close, s.shape[1])
            real[close] = exact(left.x[rows], right.x[cols], self.metric)
        if self.value:
            real[:] = self.value(real)
        at = np.arange(len(real), dtype=np.uint64)
        if len(at) >= SORTED:  # as integers: a value's first bits, then its place
            at |= real.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            at.sort()
        at = at.astype(np.uint32)
        real = real[at]
        rows = at // wide
        at -= rows * wide
        self.found.append((rows + np.uint32(first), left.ids[rows], right.ids[at], real))

    def told(self) -> tuple[np.ndarray, list]:
        rows, *rest = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*self.found))
        return rows, rest


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero, as in SQL engines; what is rounded to zero keeps its sign."""
    scaled = np.abs(x)
    scaled *= 10.0**digits
    whole = np.floor(scaled)
    scaled -= whole
    whole += scaled >= 0.5
    whole /= 10.0**digits
    return np.copysign(whole, x, out=whole)


def all_pairs(queries: DataFrame, bank: DataFrame, *, metric: str = "l2", keys: tuple[str, ...] = (), block: int | None = None, value: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """keys, id, neighbour, score of every pair with equal keys, where the pairs themselves are asked for (J7, J12). value: what stands for the scores, reckoned inside tasks."""
    fields = [T.StructField("id", queries.schema["id"].dataType), T.StructField("neighbour", bank.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    return tiles(queries, bank, lambda left: _Pairs(left, metric, value), fields, metric=metric, keys=keys, block=block or PAIRS, held=2 * SCORES)


class _Sums:
    """Sums of a function of the scores over the rows of each value of a column on either side."""

    def __init__(self, left: Side, f: Callable[[np.ndarray], np.ndarray], by: str) -> None:
        self.f, self.by, self.sums = f, by, {}

    def add(self, s: np.ndarray, off: np.ndarray, left: Side, first: int, right: Side) -> None:
        s = self.f(s)
        mine, other = (pc.dictionary_encode(x.more[self.by], null_encoding="encode") for x in (left, right))
        inner = np.zeros((len(s), len(other.dictionary)))
        for j in range(len(other.dictionary)):
            inner[:, j] = s[:, other.indices.to_numpy() == j].sum(axis=1)
        for i, p in enumerate(mine.dictionary.to_pylist()):
            for j, q in enumerate(other.dictionary.to_pylist()):
                v, n = self.sums.get((p, q), (0.0, 0))
                rows = mine.indices.to_numpy() == i
                self.sums[p, q] = v + inner[rows, j].sum(), n + int(rows.sum()) * int((other.indices.to_numpy() == j).sum())

    def told(self) -> tuple[np.ndarray, list]:
        return np.zeros(len(self.sums), np.int64), [[p for p, _ in self.sums], [q for _, q in self.sums], [v for v, _ in self.sums.values()], [n for _, n in self.sums.values()]]


def pair_sums(left: DataFrame, right: DataFrame, f: Callable[[np.ndarray], np.ndarray], by: str, *, metric: str = "dot", keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """keys, p, q, s, n: the sum of f(score) and the number of all pairs of equal keys, for each value p of a column of the left and q of the right (J10). A task sends on one row for each of these."""
    kind = left.schema[by].dataType
    fields = [T.StructField("p", kind), T.StructField("q", kind), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())]
    found = tiles(left, right, lambda rows: _Sums(rows, f, by), fields, metric=metric, keys=keys, more=([by], [by]), block=block)
    return found.groupBy(*keys, "p", "q").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


class _LogSum:
    """For each query the largest scaled score and the sum of exp(scaled score - largest)."""

    def __init__(self, left: Side, scale: float) -> None:
        self.scale, self.ids = scale, left.ids
        self.top, self.sum = np.full(len(left.ids), -np.inf), np.zeros(len(left.ids))

    def add(self, s: np.ndarray, off: np.ndarray, left: Side, first: int, right: Side) -> None:
        s = s * self.scale
        here = slice(first, first + len(s))
        top = np.maximum(self.top[here], s.max(axis=1))
        self.sum[here] = self.sum[here] * np.exp(self.top[here] - top) + np.exp(s - top[:, None]).sum(axis=1)
        self.top[here] = top

    def told(self) -> tuple[np.ndarray, list]:
        return np.arange(len(self.ids)), [self.ids, self.top, self.sum]


def log_sums(queries: DataFrame, bank: DataFrame, scale: float, *, metric: str = "cos", block: int | None = None) -> DataFrame:
    """id, log_sum: log of the sum of exp(scale * score) over the bank, for each query; blocks send on the largest term and a sum scaled by it, so none overflows."""
    fields = [T.StructField("id", queries.schema["id"].dataType), T.StructField("top", T.DoubleType()), T.StructField("s", T.DoubleType())]
    parts = tiles(queries, bank, lambda left: _LogSum(left, scale), fields, metric=metric, block=block)
    whole = parts.groupBy("id").agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "s")).alias("parts"))  # one for each block of the bank
    return whole.select("id", (F.col("m") + F.log(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"] * F.exp(p["top"] - F.col("m"))))).alias("log_sum"))


def radius(points: DataFrame, k: int, *, keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """keys, id, r: distance to the (k + 1)-th nearest of the set, in which the point itself is one."""
    return nearest(points, points, k + 1, keys=keys, block=block).where(F.col("place") == k + 1).select(*keys, "id", F.sqrt(-F.col("score")).alias("r"))


class _Covered:
    """Whether a probe lies in some ball, the surface included."""

    def __init__(self, left: Side) -> None:
        self.ids, self.hit = left.ids, np.zeros(len(left.ids), bool)

    def add(self, s: np.ndarray, off: np.ndarray, left: Side, first: int, right: Side) -> None:
        r = right.more["r"].to_numpy(zero_copy_only=False)
        gap = s + r * r  # at least 0 inside
        slack = 2 * off[:, None] + 1e-12 * r * r
        hit = (gap > slack).any(axis=1)
        rows, cols = np.nonzero((np.abs(gap) <= slack) & ~hit[:, None])
        inside = np.sqrt(-exact(left.x[rows], right.x[cols], "l2")) <= r[cols]
        hit[rows[inside]] = True
        self.hit[first : first + len(s)] |= hit

    def told(self) -> tuple[np.ndarray, list]:
        return np.arange(len(self.ids)), [self.ids, self.hit]


def covered(probes: DataFrame, balls: DataFrame, *, keys: tuple[str, ...] = (), block: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """keys, id, hit: whether a probe lies in some ball (x, r), the surface included. sized: see tiles()."""
    fields = [T.StructField("id", probes.schema["id"].dataType), T.StructField("hit", T.BooleanType())]
    found = tiles(probes, balls, _Covered, fields, metric="l2", keys=keys, more=([], ["r"]), block=block, sized=sized)
    every = probes.select(*keys, "id", F.lit(False).alias("hit"))  # also those that no ball can meet
    return found.unionByName(every).groupBy(*keys, "id").agg(F.bool_or("hit").alias("hit"))


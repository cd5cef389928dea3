"""Windows of texts that occur earlier in the corpus, with bounded state in each task.

Suffixes are sampled at anchors (see anchors.py), of which every window has one. Three passes, each of which leaves little:

1. Each run of windows is a row (prefix of k symbols at the anchor, all symbols of the run, document, place), by hashes of
   them, through an external sort. Rows with all symbols in common are copies: all but the first are repeated. A prefix with
   one kind of row only is settled by that.
2. What is left of prefixes with several kinds goes, with its symbols, to one task for each prefix; there suffixes are sorted
   and compared by their symbols (see subtrees.py).
3. A prefix with more than `GROUP` rows left is lengthened to the whole window: each window is a row by its own hash, through
   a second external sort, and what follows the first of equals is repeated.

Tasks settle what they can of their own texts before a shuffle, so a passage that a third of all documents share is one row
for each batch, not one for each document. Sorts are read as streams; a task holds one batch, or a group of `GROUP` rows.
Hashes that decide equality have 128 bits (pass 1) and 128 bits (pass 3).

A document is known by its id and, where that is null or found in several rows, by a 64-bit hash of its text beside it; equal
rows are one document here and get equal results. Different texts with one id are different documents, neither of them earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from .anchors import Symbols, of_bytes, of_words, runs
from .common import pieces, raw, written
from .subtrees import Group, repeated

NO_ID = -(2**63)
ALPHABETS: dict[str, Callable[..., Symbols]] = {"bytes": of_bytes, "words": of_words}
#: Rows of one prefix that a task sorts in memory.
GROUP = 1024
#: In a span's code: its prefix is to be lengthened.
LONG = 1 << 15


def keyed(docs: DataFrame, doc_id: str) -> DataFrame:
    """docs with __doc and __tag, which tell documents apart."""
    number = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("__doc", "__tag", "__several")]).withColumn("__doc", number)
    several = written(docs.groupBy("__doc").count().where((F.col("count") > 1) & (F.col("__doc") != NO_ID)).select("__doc", F.lit(True).alias("__several")), "ids")
    return docs.join(several, "__doc", "left")


def tag_of(text: str) -> F.Column:
    """0 for a document that its id tells apart."""
    return F.when(F.col("__several") | (F.col("__doc") == NO_ID), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))).otherwise(F.lit(0).cast("long"))


def packed(docs: DataFrame, text: str) -> DataFrame:
    """docs with __text, the compressed text, in place of text: what a join by id has to move."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "__text"])
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields, T.StructField("__text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            column = batch.column(text)
            made = [(small.compress(x) if x else b"") if ok else None for x, ok in zip(raw(column), column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(made, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def unpacked(column: pa.Array) -> list[bytes | None]:
    large = zstandard.ZstdDecompressor()
    return [large.decompress(x) if x else x for x in column.to_pylist()]


def span_code(first: np.ndarray, count: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """First window, number of windows and symbols from the first to the anchor in one long, in order of place."""
    return (first << 32) | (count << 16) | lead


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_ROWS = "k1 long, k2 long, doc long, tag long, span long, done boolean"
_NAMES = ["k1", "k2", "doc", "tag", "span"]


def _row_batch(cols: list[np.ndarray], same_doc: bool) -> pa.RecordBatch:
    """Rows (k1, k2, doc, tag, span) less repetitions of a row; those that come after the first of equal windows are done."""
    order = np.lexsort(cols[::-1])
    k1, k2, doc, tag, span = cols = [c[order] for c in cols]
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    again = np.zeros(n, bool)
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])
    done = doc != doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if n else new
    if same_doc:
        done = done | (again & np.append(False, span[1:] != span[:-1]))
    keep = ~(again & np.append(False, span[1:] == span[:-1])) if n else new
    # settled rows need no meeting place: their documents spread them
    k1 = np.where(done, (doc ^ tag) * np.int64(-7046029254386353131), k1)
    cols = [k1, np.where(done, 0, k2), doc, tag, span, done]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=[*_NAMES, "done"])


class Stream:
    """Settles rows that arrive in the order (k1, k2, doc, tag, span)."""

    def __init__(self, same_doc: bool, keep_open: bool):
        self.same_doc, self.keep_open = same_doc, keep_open
        self.last: tuple[int, ...] | None = None  # k1, k2, doc, tag, span
        self.first = 0  # document of the first row with the last row's keys
        self.classes, self.held = 0, []

    def take(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        """k1, doc, tag, span and whether open, of the rows settled as repeated or, if keep_open, left open."""
        k1, k2, doc, tag, span = cols
        n = len(doc)
        if not n:
            return [k1, doc, tag, span, np.zeros(0, bool)]
        other = [np.append(self.last is None or c[0] != self.last[i], c[1:] != c[:-1]) for i, c in enumerate(cols)]
        group, new = other[0], other[0] | other[1]
        same = ~(new | other[2] | other[3])
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        later = doc != np.where(start < 0, self.first, doc[start])
        if self.same_doc:
            later |= same & other[4]
        repeat = same & ~other[4]  # the same row once more
        later &= ~repeat
        out = [(later, np.zeros(int(later.sum()), bool))]
        made = [[c[m] for c in (k1, doc, tag, span)] + [o] for m, o in out]
        if self.keep_open:
            g = np.cumsum(group)
            classes = np.bincount(g, new).astype(np.int64)
            classes[0] += 0 if group[0] else self.classes
            several = classes >= 2
            if several[0]:
                made += self.held
            if several[0] or g[-1] > 0:
                self.held = []
            left = ~later & ~repeat
            send = left & several[g]
            made.append([c[send] for c in (k1, doc, tag, span)] + [np.ones(int(send.sum()), bool)])
            if not several[g[-1]]:
                keep = left & (g == g[-1])
                self.held.append([c[keep] for c in (k1, doc, tag, span)] + [np.ones(int(keep.sum()), bool)])
            self.classes = int(classes[-1])
        self.last = tuple(int(c[-1]) for c in cols)
        if start[-1] >= 0:
            self.first = int(doc[start[-1]])
        return [np.concatenate([m[i] for m in made]) for i in range(5)]


_SETTLED = "k1 long, doc long, tag long, span long, open boolean"


def _settled(rows: DataFrame, same_doc: bool, keep_open: bool, name: str) -> DataFrame:
    """rows (k1, k2, doc, tag, span, done): those done, and what a stream over the others finds, as (k1, doc, tag, span, open). Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(same_doc, keep_open)
        for batch in batches:
            *cols, done = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            found = stream.take([c[~done] for c in cols])
            found[0] = np.where(found[4], found[0], 0)
            n = int(done.sum())
            told = [np.zeros(n, np.int64), *(c[done] for c in cols[2:]), np.zeros(n, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(told, found)], names=["k1", "doc", "tag", "span", "open"])

    ordered = rows.repartition("k1").sortWithinPartitions(*_NAMES)
    return written(ordered.mapInArrow(run, _SETTLED), name)


def _windows(s: Symbols, base: int, first: int, count: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit hash of each window of a run."""
    made = [xxh3_128_intdigest(s.data[s.begin[base + w] : s.end[base + w + length - 1]]) for w in range(first, first + count)]
    return _signed([h & (1 << 64) - 1 for h in made]), _signed([h >> 64 for h in made])


_MIXED = "wide boolean, k1 long, k2 long, doc long, tag long, span long, done boolean, data binary"
_MIXED_NAMES = ["wide", *_NAMES, "done", "data"]


class Groups:
    """Solves groups of rows (k1, doc, tag, span, data) that arrive in the order of k1."""

    def __init__(self, alphabet: str, length: int, k: int, same_doc: bool):
        self.alphabet, self.length, self.k, self.same_doc = alphabet, length, k, same_doc
        self.held: list[pa.RecordBatch] = []

    def take(self, batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for start in range(0, batch.num_rows, 4 * GROUP):
            self.held.append(batch.slice(start, 4 * GROUP))
            if sum(b.num_rows for b in self.held) > 8 * GROUP:
                yield self.cut(False)

    def cut(self, final: bool) -> list[np.ndarray]:
        """doc, tag, span of repeated runs among the groups held, the last one only if final."""
        table = pa.Table.from_batches(self.held)
        g = table["k1"].to_numpy()
        change = np.flatnonzero(g[1:] != g[:-1]) + 1
        end = len(g) if final else int(change[-1]) if len(change) else 0
        self.held = table.slice(end).to_batches()
        table = table.slice(0, end).combine_chunks()
        g, doc, tag, span = (table[c].to_numpy() for c in ("k1", "doc", "tag", "span"))
        anchor = (span >> 32) + (span & 0x7FFF)
        order = np.lexsort([anchor, tag, doc])
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (g, doc, tag, span)])
        order = order[new]  # equal rows are one document
        g, doc, tag, span = (c[order] for c in (g, doc, tag, span))
        first, count, lead = span >> 32, span >> 16 & 0xFFFF, span & 0x7FFF
        data = table["data"].combine_chunks().take(pa.array(order)).to_pylist() if len(order) else []
        starts = np.append(0, np.cumsum(count + self.length - 1))
        if self.alphabet == "bytes":
            symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.uint16) + np.uint16(1)
        else:
            words = b" ".join(data).split()
            codes = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
            symbols = np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))
        group = np.unique(g, return_inverse=True)[1]
        row, at, n = repeated(Group(group, doc, tag, lead, count, symbols, starts), self.length, self.k, self.same_doc)
        return [doc[row], tag[row], span_code(first[row] + at, n, np.zeros(len(row), np.int64))]


def repeated_spans(docs: DataFrame, doc_id: str, text: str, alphabet: str, *, length: int, k: int, same_doc: bool) -> DataFrame:
    """(doc, tag, span): runs of windows that also start in a document of a smaller id or, with same_doc, earlier in their own."""
    symbols_of = ALPHABETS[alphabet]
    if not 0 < k <= length or length - k >= 1 << 15:
        raise ValueError("k must be within the window, and a window at most 32,768 symbols longer")
    told = keyed(docs.select(doc_id, text), doc_id).select(F.col("__doc").alias("doc"), tag_of(text).alias("tag"), F.col(text).alias("text"))

    def name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw(batch.column(2))
            made: list[list[np.ndarray]] = []
            for a, b in pieces([len(x) for x in texts]):
                s = symbols_of(texts[a:b])
                r = runs(s, length, k)
                base = s.edges[r.text]
                grams = _signed([s.hash(x, x + k - 1) for x in (r.anchor + base).tolist()])
                spans = _signed([s.hash(x, x + n + length - 2) for x, n in zip((r.first + base).tolist(), r.count.tolist())])
                # equal spans with their anchor at another place are other windows
                spans ^= ((r.anchor - r.first) * 65536 + r.count) * np.int64(-7046029254386353131)
                made.append([grams, spans, ids[a:b][r.text], tags[a:b][r.text], span_code(r.first, r.count, r.anchor - r.first)])
                if sum(len(m[0]) for m in made) > 1_000_000:
                    yield _row_batch([np.concatenate(c) for c in zip(*made)], same_doc)
                    made = []
            if made:
                yield _row_batch([np.concatenate(c) for c in zip(*made)], same_doc)

    def texts_asked(batch: pa.RecordBatch) -> Iterator[tuple[Symbols, int, int, int, list[int]]]:
        """Symbols of a piece, where a text begins in them, its id and tag, and the spans asked of it."""
        ids, tags, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
        texts = [x or b"" for x in unpacked(batch.column(2))]
        for a, b in pieces([len(x) for x in texts], 500_000):
            s = symbols_of(texts[a:b], coded=False)
            for i in range(a, b):
                yield s, int(s.edges[i - a]), int(ids[i]), int(tags[i]), asked[i]

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            made: list[list[np.ndarray]] = []

            def windows() -> pa.RecordBatch:
                out = _row_batch([np.concatenate(c) for c in zip(*made)], same_doc)
                made.clear()
                n = out.num_rows
                return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), *out.columns, pa.nulls(n, pa.binary())], names=_MIXED_NAMES)

            for s, base, doc, tag, asked in texts_asked(batch):
                for code in asked:
                    first, count, lead = code >> 32, code >> 16 & 0xFFFF, code & 0x7FFF
                    if code & LONG:
                        k1, k2 = _windows(s, base, first, count, length)
                        made.append([k1, k2, np.full(count, doc), np.full(count, tag), span_code(np.arange(first, first + count), np.int64(1), np.int64(0))])
                    else:
                        at = base + first
                        data = bytes(s.data[s.begin[at] : s.end[at + count + length - 2]])
                        rows.append((s.hash(at + lead, at + lead + k - 1), doc, tag, code, data))
                if len(made) > 20_000:
                    yield windows()
            if made:
                yield windows()
            if rows:
                n, (g, doc, tag, code, data) = len(rows), zip(*rows)
                yes_no, zeros = pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([yes_no, pa.array(_signed(list(g))), zeros, *[pa.array(x, pa.int64()) for x in (doc, tag, code)], yes_no, pa.array(data, pa.binary())], names=_MIXED_NAMES)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, stream = Groups(alphabet, length, k, same_doc), Stream(same_doc, False)
        batch_of = lambda cols: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "tag", "span"])
        for batch in batches:
            is_wide = batch.column(0).to_numpy(zero_copy_only=False)
            n = int((~is_wide).sum())  # they come first
            for found in groups.take(batch.slice(0, n)):
                yield batch_of(found)
            if n < batch.num_rows:
                *cols, done = (c.to_numpy(zero_copy_only=False) for c in batch.slice(n).columns[1:7])
                found = stream.take([c[~done] for c in cols])
                yield batch_of([np.concatenate([c[done], f]) for c, f in zip(cols[2:], found[1:4])])
        if groups.held:
            yield batch_of(groups.cut(True))

    settled = _settled(told.mapInArrow(name_runs, _ROWS), same_doc, True, "runs")
    left = settled.where("open")
    large = written(left.groupBy("k1").count().where(F.col("count") > GROUP).select("k1", F.lit(LONG).cast("long").alias("long")), "prefixes")
    marked = left.join(large, "k1", "left").select("doc", "tag", F.col("span").bitwiseOR(F.coalesce("long", F.lit(0).cast("long"))).alias("span"))
    asked = marked.groupBy("doc", "tag").agg(F.collect_list("span").alias("asked"))
    rows = packed(told, "text").join(asked, ["doc", "tag"]).select("doc", "tag", "__text", "asked").mapInArrow(mixed, _MIXED)
    found = rows.repartition("k1").sortWithinPartitions("wide", *_NAMES).mapInArrow(settle, "doc long, tag long, span long")
    return settled.where("not open").select("doc", "tag", "span").union(written(found, "subtrees"))


def cut(docs: DataFrame, doc_id: str, text: str, alphabet: str, spans: DataFrame, *, length: int, joint: bytes, as_text: bool = False) -> DataFrame:
    """docs, less the text, with n_symbols, n_removed, n_spans (maximal runs removed) and kept (the rest as bytes, null for a null text; as_text: as a string, without what is left of a character that was cut)."""
    names = ("n_symbols", "n_removed", "n_spans", "kept", "__doc", "__tag", "__several", "__text", "__spans")
    docs = keyed(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]), doc_id)
    small = packed(docs.withColumn("__tag", tag_of(text)).drop("__several"), text)
    per_doc = spans.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list("span").alias("__spans"))
    mine = [c for c in small.columns if not c.startswith("__")]
    joined = small.join(per_doc, ["__doc", "__tag"], "left").select(*[F.col(f"`{c}`") for c in mine], "__text", "__spans")
    fields = [T.StructField(c, T.LongType()) for c in ("n_symbols", "n_removed", "n_spans")]
    schema = T.StructType([*small.select(*[F.col(f"`{c}`") for c in mine]).schema.fields, *fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    symbols_of = ALPHABETS[alphabet]

    def rest(data: bytes | None, codes: list[int] | None) -> tuple[int, int, int, bytes | None]:
        if data is None:
            return 0, 0, 0, None
        s = symbols_of([data], coded=False)
        n = len(s.begin)
        gone = np.zeros(n + 1, np.int32)
        found = np.array(codes or (), np.int64)
        np.add.at(gone, found >> 32, 1)
        np.add.at(gone, (found >> 32) + (found >> 16 & 0xFFFF) + length - 1, -1)
        gone = np.cumsum(gone)[:n] > 0
        # kept runs lie between an edge down and an edge up
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
        parts = [bytes(s.data[s.begin[a] : s.end[b - 1]]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return n, int(gone.sum()), n_spans, joint.join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rest(t, c) for t, c in zip(unpacked(batch.column(len(mine))), batch.column(len(mine) + 1).to_pylist())]
            more = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            more.append(pa.array([None if f[3] is None else f[3].decode(errors="ignore") for f in found], pa.string()) if as_text else pa.array([f[3] for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(mine)], *more], names=schema.names)

    return joined.mapInArrow(run, schema)

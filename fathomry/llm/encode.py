"""BPE encoding and decoding with a transducer lexicon of frequent words.

Words are runs of anything but ASCII white space. `frequent_words` counts them over the whole corpus; those with a share of at
least `min_share` are compiled with their ids into a minimal acyclic transducer (2 / min_share words at most, whatever the
corpus). Tasks map that file into memory and walk it for many words at once; words it lacks are normalised, parted and merged
exactly. Both ways give the tokenizer's ids. A task keeps the ids of words it has met, in a table of bounded size.

Defined results: a null or empty text has no ids and decodes to an empty text; strings of special tokens inside a text become
those tokens, as the tokenizer has it by default; equal texts have equal ids; texts may be of any length (they are cut at
nothing, and words of any length are merged in n log n); an empty table gives an empty table; input columns named like an
output are replaced.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Merges, split_special
from .classes import WHITE, finder, lowered
from .common import append, pieces, sizes_of, table, without, written
from .lexicon import Lexicon, compile_words

#: The word-end vocabulary's pattern for the parts of a word.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
_PARTS_OR_BREAK = finder(r"\n|" + PATTERN)
#: Words, and bytes of words, that a task remembers beside the lexicon.
REMEMBERED, REMEMBERED_BYTES = 400_000, 16_000_000


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows' boundaries among all words, each word's number among the distinct ones, and those."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = parts.flatten().dictionary_encode()
    rows = parts.offsets.to_numpy()
    return rows - rows[0], coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()


class Encoder:
    """Ids of words: row r of the table is ids[starts[r] : starts[r] + sizes[r]]."""

    def __init__(self, description: bytes, lexicon: str | None):
        self.merges = Merges(description)
        self.special = {k.encode(): v for k, v in self.merges.special.items()}
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.names = pa.array([n.decode() for n in self.merges.names], pa.string())
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.n_bytes = 0
        self.ids, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The table's row of each of some distinct words; those it lacks are learnt."""
        get = self.known.get
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED or self.n_bytes > REMEMBERED_BYTES:
            self.forget()
            get, new = self.known.get, [w for w in words if w]
        if new:
            found = self.ids_of(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first, n = len(self.sizes), len(self.ids)
            self.known.update(zip(new, range(first, first + len(new))))
            self.n_bytes += sum(map(len, new))
            self.starts = np.concatenate([self.starts, n + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        return np.fromiter(map(get, words), np.int64, len(words))

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian: from the lexicon, or merged."""
        out: list[bytes] = [b""] * len(words)
        numbers = self.lexicon.find(words) if self.lexicon else np.full(len(words), -1)
        listed = np.flatnonzero(numbers >= 0)
        if len(listed):
            flat, ends = self.lexicon.ids, self.lexicon.begins
            for i, a, b in zip(listed.tolist(), ends[numbers[listed]].tolist(), ends[numbers[listed] + 1].tolist()):
                out[i] = flat[a:b].astype("<u4").tobytes()
        rest = np.flatnonzero(numbers < 0).tolist()
        for i, made in zip(rest, self.merged([words[i] for i in rest])):
            out[i] = made
        return out

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without the lexicon."""
        split = {w: split_special(w, self.special) for w in words if b"<|" in w}
        plain = list(dict.fromkeys([*(w for w in words if w not in split), *(x for parts in split.values() for x, is_special in parts if not is_special)]))
        of = dict(zip(plain, self._merged(plain)))
        for w, parts in split.items():
            of[w] = b"".join(self.special[x].to_bytes(4, "little") if is_special else of[x] for x, is_special in parts)
        return [of[w] for w in words]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """For words without special strings: one search and one merge for all of them."""
        if not words:
            return []
        flat = _PARTS_OR_BREAK(lowered(b"\n".join(words).decode()))
        distinct = list(dict.fromkeys(flat))
        ids, starts = self.merges.merge([b"" if p == "\n" else p.encode() for p in distinct])
        data, at = ids.astype("<u4").tobytes(), (4 * starts).tolist()
        of = dict(zip(distinct, map(data.__getitem__, map(slice, at, at[1:]))))
        parts = list(map(of.__getitem__, flat))
        data, ends = b"".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, flat), bool, len(flat)))
        cuts = [0, *ends[breaks].tolist(), len(data)]
        return list(map(data.__getitem__, map(slice, cuts, cuts[1:])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries of each text's ids, and all ids."""
        rows, at, distinct = split_words(texts)
        row = self.rows(distinct)[at]
        sizes = self.sizes[row]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.starts[row] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ends[rows], flat

    def decode(self, ends: np.ndarray, flat: np.ndarray) -> pa.Array:
        """This vocabulary has no decoder, so a text is its tokens with spaces between."""
        tokens = self.names.take(pa.array(flat))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens), " ")


def packed_ids(ends: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Each text's ids as binary."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


_ENCODERS: dict = {}


def _encoder(name: str, shared: Broadcast, lexicon: str | None) -> Encoder:
    """One encoder for each Python worker, vocabulary and lexicon."""
    key = (name, lexicon)
    if key not in _ENCODERS:
        if len(_ENCODERS) > 3:
            _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, SparkFiles.get(lexicon) if lexicon else None)
    return _ENCODERS[key]


def count_words(docs: DataFrame, text: str = "text", *, least: float = 0.0) -> DataFrame:
    """word, n; the row of a null word has the number of all words. What has a share under `least` in a piece of text is left out there, so a count lacks at most that share of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in pieces(sizes_of(texts), 8_000_000):
                coded = pc.ascii_split_whitespace(pc.fill_null(texts.slice(a, b - a), "")).flatten().dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                often = np.flatnonzero(n >= max(1, least * len(coded)))
                words = pa.concat_arrays([coded.dictionary.take(pa.array(often)), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[often], len(coded)), pa.int64())], names=["word", "n"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text: str = "text", *, min_share: float = 1 / 65536) -> list[bytes]:
    """All words with at least that share of all words, sorted, and some with at least half of it: 2 / min_share at most."""
    counts = written(count_words(docs, text, least=min_share / 2), "words")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    # the share bounds what comes to the driver
    return sorted(r["word"].encode() for r in counts.where((F.col("n") >= total * min_share / 2) & (F.col("word") != "")).select("word").collect())


def ship_lexicon(spark: SparkSession, description: bytes, words: list[bytes]) -> str:
    """Compiles the lexicon and hands the file to every executor, those that join later included; returns the file's name."""
    words = [w for w in words if b"<|" not in w]
    made = Encoder(description, None).merged(words)
    compiled = compile_words(words, [np.frombuffer(x, "<u4").astype(np.int32) for x in made])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    compiled.tofile(path)
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, vocabulary: str, text: str = "text", *, min_share: float = 1 / 65536, back: bool = False) -> DataFrame:
    """docs with ids (unsigned 32-bit, little-endian) and n_tokens; back: also with decoded, the text of those ids, in the same pass. vocabulary: path of a word-end BPE description in JSON."""
    spark = docs.sparkSession
    description = Path(vocabulary).read_bytes()
    name, shared = xxhash.xxh64_hexdigest(description), spark.sparkContext.broadcast(description)
    lexicon = ship_lexicon(spark, description, frequent_words(docs, text, min_share=min_share))

    def make():
        encoder = _encoder(name, shared, lexicon)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            ends, flat = encoder.encode(batch.column(text).cast(pa.string()))
            return [packed_ids(ends, flat), *([encoder.decode(ends, flat)] if back else [])]

        return run

    fields = [T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if back else [])]
    out = append(docs, fields, make, text)
    return without(out, "n_tokens").select("*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of its ids."""
    description = Path(vocabulary).read_bytes()
    name, shared = xxhash.xxh64_hexdigest(description), df.sparkSession.sparkContext.broadcast(description)

    def make():
        encoder = _encoder(name, shared, None)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [x or b"" for x in batch.column(ids).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in rows)])
            return [encoder.decode(ends, np.frombuffer(b"".join(rows), "<u4"))]

        return run

    return append(df, [T.StructField("decoded", T.StringType())], make)


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = encode(docs, path, back=True).drop("text")
    return out.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("ids", "decoded")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: documents as token ids, in place of their texts."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")

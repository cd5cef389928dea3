"""Token counts at every prefix of a text.

A text is a row of units, each a run of white space and the run of other characters after it; no token crosses from one unit
to the next. So the count at any prefix follows a recurrence: count(prefix) = count(up to the unit it ends in) + count(what
it takes of that unit). Inside a unit the same holds of its words (the vocabulary's parts of a text), and inside a word a second
recurrence over its bytes gives the count of every prefix from that of a shorter one: the last token of a prefix is the one that
keeps its place beside the last token of what comes before it. `prefix_counts` stores the count at every prefix; the count of a
text is that of its longest prefix, and questions about budgets and truncation are searches in what is stored.

Defined results: a null or empty text has no units, prefixes or tokens; equal texts have equal counts; a unit may be of any length
(time and memory are in proportion); special strings in a unit part it, and less than one is text; equal rows get equal results; an
empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LONG, Merges, split_special
from .classes import WHITE, finder
from .common import append, raw, table

#: The byte-level vocabularies' pattern for parts of a text.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}%s\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}%s])|[{WHITE}]+"
#: A noncharacter that parts units, so that one search serves many; a unit that holds it is searched alone.
_END = "\ufdd0"
_parts, _together = finder(_PATTERN % ("", "")), finder(f"{_END}|" + _PATTERN % (_END, _END))
_WHITE_OF_MORE_BYTES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNITS, _ASCII_UNITS = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"), re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_SPACE = regex.compile(rf"[{WHITE}]*")
_RUN = re.compile(f"[{WHITE}]{{2,}}")
#: Distinct units or words, and characters of them, that a task remembers.
REMEMBERED, REMEMBERED_CHARACTERS = 200_000, 8_000_000


class Store:
    """Counts at every prefix, by characters and without the empty one, of many distinct strings, end to end in one array."""

    def __init__(self) -> None:
        self.index: dict = {}
        self.forget()

    def forget(self) -> None:
        self.index.clear()
        self.flat, self.starts, self.sizes, self.totals = np.zeros(1 << 16, np.int32), *(np.zeros(1 << 12, np.int64) for _ in range(3))
        self.n = 0

    def full(self, more: int) -> bool:
        return bool(self.index) and (len(self.index) + more > REMEMBERED or self.n > REMEMBERED_CHARACTERS)

    def add(self, strings: list, counts: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct strings that are not known, and their counts end to end."""
        k, n = len(self.index), self.n
        self.flat = _room(self.flat, n + len(counts))
        self.flat[n : n + len(counts)] = counts
        ends = n + np.cumsum(sizes)
        for name, values in (("starts", ends - sizes), ("sizes", sizes), ("totals", np.where(sizes > 0, self.flat[np.maximum(ends - 1, 0)], 0))):
            held = _room(getattr(self, name), k + len(strings))
            held[k : k + len(strings)] = values
            setattr(self, name, held)
        self.index.update(zip(strings, range(k, k + len(strings))))
        self.n += len(counts)

    def ids(self, strings: Iterable, n: int) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, strings), np.int64, n)

    def of(self, string) -> np.ndarray:
        i = self.index[string]
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of strings, ids[bounds[i]:bounds[i + 1]] each: counts at every prefix of the strings of a row put together, end to end; how many a row has; its count at each string's end. count(prefix) = count(up to its last string) + count(the rest of it)."""
        totals, sizes = self.totals[ids], self.sizes[ids]
        ends, at = np.cumsum(totals), np.concatenate([[0], np.cumsum(sizes)])
        ends -= np.repeat(np.concatenate([[0], ends])[bounds[:-1]], np.diff(bounds))
        counts = self.flat[np.repeat(self.starts[ids] - at[:-1], sizes) + np.arange(at[-1])]
        counts += np.repeat((ends - totals).astype(np.int32), sizes)
        return counts, np.diff(at[bounds]), ends


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Counter:
    """Counts the tokens of every prefix of words and units, and remembers them."""

    def __init__(self, description: bytes):
        self.merges = Merges(description)
        self.special = [s.encode() for s in self.merges.special]
        self.known, self.words = Store(), Store()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.asked, self.asked_yes = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def units(self, text: bytes) -> list[bytes]:
        if not text.isascii() and _WHITE_OF_MORE_BYTES.search(decoded := text.decode()):
            return [u.encode() for u in _UNITS.findall(decoded)]
        return _ASCII_UNITS.findall(text)

    def learn(self, units: set[bytes]) -> None:
        """Counts at every prefix of units, from those of their words."""
        fresh = units - self.known.index.keys()
        if self.known.full(len(fresh)):
            self.known.forget()
            fresh = units
        plain: list[bytes] = []
        for u in fresh:
            if b"<|" in u or b"\xef\xb7" in u:
                counts = self.unit_prefixes(u)[1][1:]
                self.known.add([u], np.array(counts, np.int32), np.array([len(counts)]))
            else:
                plain.append(u)
        if not plain:
            return
        # one search over all units; each is followed by an end
        texts = [u.decode() for u in plain]
        words = _together(_END.join([*texts, ""]))
        runs = {i: m[0] for i, m in enumerate(map(_RUN.match, texts)) if m}
        self._learn_words({*words, *runs.values()})
        ids = self.words.ids(words, len(words))
        is_end = ids == self.words.index[_END]
        bounds = np.concatenate([[0], np.cumsum(~is_end)[is_end]])
        counts, sizes, _ = self.words.joined(ids[~is_end], bounds)
        starts = np.cumsum(sizes) - sizes
        for i, run in runs.items():  # what ends inside the white space is one word
            counts[starts[i] : starts[i] + len(run)] = self.words.of(run)
        self.known.add(plain, counts, sizes)

    def _learn_words(self, words: set[str]) -> None:
        fresh = words - self.words.index.keys()
        if self.words.full(len(fresh)):
            self.words.forget()
            fresh = words
        odd = {w for w in fresh if len(w) > LONG // 4 and len(w.encode()) > LONG or w[0] == "'" and w[1:].isalpha()}
        for w in odd:
            x = w.encode()
            counts = np.array((self._contraction if x[:1] == b"'" and x[1:].isalpha() else self._recurrence)(x)[1:], np.int32)
            counts = counts[(np.frombuffer(x[1:] + b" ", np.uint8) & 0xC0) != 0x80]
            self.words.add([w], counts, np.array([len(counts)]))
        if _END in fresh:
            self.words.add([_END], np.zeros(0, np.int32), np.zeros(1, np.int64))
        rest = [(w, x) for w, x in zip(fresh, map(str.encode, fresh)) if w not in odd and w != _END]
        rest.sort(key=lambda r: -len(r[1]))
        for k in range(0, len(rest), 50_000):
            some, encoded = zip(*rest[k : k + 50_000])
            self.words.add(list(some), *self._many(encoded))

    def _many(self, words: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each prefix by characters of many words, the longest first, end to end, and how many each has: the recurrence, one place of all words at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths[0])
        used = np.arange(width) < lengths[:, None]
        data = np.zeros((len(words), width + 1), np.uint8)
        data[:, :width][used] = np.frombuffer(b"".join(words), np.uint8)
        counts, last = np.zeros((len(words), width + 1), np.int32), np.full((len(words), width + 1), -1, np.int32)
        tokens = self.merges.endings()
        for i in range(1, width + 1):
            rows = np.arange(np.searchsorted(-lengths, -i, "right"))
            node = np.zeros(len(rows), np.int64)
            for k in range(i - 1, -1, -1):
                node, token = tokens.step(node, data[rows, k])
                kept = np.flatnonzero(token >= 0)
                kept = kept[self._stay(last[rows[kept], k], token[kept])]
                done = rows[kept]
                counts[done, i], last[done, i] = counts[done, k] + 1, token[kept]
                if len(kept) == len(rows):
                    break
                rows, node = np.delete(rows, kept), np.delete(node, kept)
        used &= (data[:, 1:] & 0xC0) != 0x80
        return counts[:, 1:][used], used.sum(axis=1)

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stays of many pairs. What was last asked for is held in a table with one place for each hash."""
        keys = (left.astype(np.int64) + 1) * self.merges.width + right
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        found, missed = self.asked_yes[slots], np.flatnonzero(self.asked[slots] != keys)
        if len(missed):
            fresh, at = np.unique(keys[missed], return_inverse=True)
            pairs = zip((fresh // self.merges.width - 1).tolist(), (fresh % self.merges.width).tolist())
            told = np.array([known if (known := self.pairs.get(p)) is not None else self._stays(p) for p in pairs])
            found[missed] = told[at]
            # of keys with one slot the last one keeps it, in both tables
            self.asked[slots[missed]] = keys[missed]
            self.asked_yes[slots[missed]] = found[missed]
        return found

    def _contraction(self, part: bytes) -> list[int]:
        """Tokens of each prefix of a contraction, by bytes: it may be more than one part."""
        return [0, *(sum(self._recurrence(x.encode())[-1] for x in _parts(part[:i].decode())) for i in range(1, len(part) + 1))]

    def unit_prefixes(self, unit: bytes, most: int | None = None) -> tuple[list[int], list[int]]:
        """Byte ends of a unit's prefixes by characters, the empty one first, and the tokens of each. most: what is longer than the last prefix of at most so many tokens is left out, or most of it, and not looked at."""
        if most is not None:  # a prefix of so many tokens has no more bytes than they
            unit = unit[: most * max(self.merges.longest, *map(len, self.special)) + 4].decode(errors="ignore").encode()
        split: list[tuple[bytes, bool]] = []
        for x, is_special in split_special(unit, self.special):
            if is_special and (not split or split[-1][1]):
                split.append((b"", False))
            split.append((x, is_special))
        counts, base = [0], 0
        for i, (x, is_special) in enumerate(split):
            if is_special:
                base += 1
                counts.append(base)
                continue
            whole = x + (split[i + 1][0][:-1] if i + 1 < len(split) else b"")  # less than a special string is text
            made = self._piece(whole, None if most is None else most - base)
            counts += [base + n for n in made[1:]]
            if len(made) <= len(x):
                break
            counts += [most + 1 for _ in range(len(whole) + 1 - len(made))]  # none, unless most cut it short
            base += made[len(x)]
            if most is not None and base > most:
                break
        data = np.frombuffer(unit + b" ", np.uint8)[: len(counts)]
        ends = np.flatnonzero((data & 0xC0) != 0x80).tolist()
        return ends, [counts[e] for e in ends]

    def _piece(self, piece: bytes, most: int | None) -> list[int]:
        """Tokens of each prefix of a text without special strings, by bytes, up to where no longer one has at most `most`."""
        text = piece.decode()
        space = len(_SPACE.match(text)[0].encode())
        counts = self._recurrence(piece[:space], most)
        if len(counts) <= space:
            return counts
        at = before = 0
        for part in map(str.encode, _parts(text)):
            if part[:1] == b"'" and part[1:].isalpha():  # of a contraction, a prefix is more than one part
                made = self._contraction(part)
            else:
                made = self._recurrence(part, None if most is None else most - before)
            counts += [before + made[i] for i in range(max(1, space + 1 - at), len(made))]
            if len(made) <= len(part):
                break
            at, before = at + len(part), before + made[-1]
            if most is not None and before > most and at > space:
                break
        return counts

    def _recurrence(self, part: bytes, most: int | None = None) -> list[int]:
        """Tokens of part[:i] for each i. The last token of a prefix is the one that keeps its place beside the last token of what comes before it, so count(i) = count(i less its bytes) + 1; merges never undo that, and just one token does. So a count is over the least of those a token's length before it: once they are all over `most`, no later one is not, and the rest is left out."""
        ids, longest, pairs, stays = self.merges.whole, self.merges.longest, self.pairs, self._stays
        counts, last, over = [0], [-1], 0
        for i in range(1, len(part) + 1):
            for k in range(i - 1, max(-1, i - longest - 1), -1):
                token = ids.get(part[k:i])
                if token is None:
                    continue
                kept = pairs.get(key := (last[k], token))
                if kept or kept is None and stays(key):
                    counts.append(counts[k] + 1)
                    last.append(token)
                    break
            over = over + 1 if most is not None and counts[-1] > most else 0
            if over > longest:
                break
        return counts

    def _stays(self, key: tuple[int, int]) -> bool:
        """Whether merging the bytes of two tokens (or, with -1, of the right one alone) gives these tokens; remembered."""
        if len(self.pairs) > 5 * REMEMBERED:
            self.pairs.clear()
        found = self.pairs[key] = self.merges.keep(*key)
        return found

    def longest_prefixes(self, rows: list[list[bytes]], starts: np.ndarray, ends: np.ndarray, totals: np.ndarray, limit: int) -> list[int]:
        """Bytes of each row's longest prefix, by characters, of at most `limit` tokens."""
        out = []
        for units, a, b in zip(rows, starts.tolist(), starts[1:].tolist()):
            k = int(np.searchsorted(totals[a:b], limit, "right"))
            n = int(ends[a + k - 1]) if k else 0
            if k < b - a:  # the budget ends in this unit
                left = limit - (int(totals[a + k - 1]) if k else 0)
                fits = np.flatnonzero(self.known.of(units[k]) <= left)
                n += len(units[k].decode()[: int(fits[-1]) + 1].encode()) if len(fits) else 0
            out.append(n)
        return out

    def prefixes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows' boundaries among units; byte end and token total at each unit's end, from its text's start."""
        return self.of_units([self.units(x) for x in texts])[:3]

    def of_units(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What prefixes() gives, then the counts at every prefix of all texts end to end, and how many each text has."""
        self.learn(set().union(*rows))
        starts = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=starts[1:])
        n = int(starts[-1])
        ends = np.cumsum(np.fromiter(map(len, chain.from_iterable(rows)), np.int64, n))
        ends -= np.repeat(np.concatenate([[0], ends])[starts[:-1]], np.diff(starts))
        counts, sizes, totals = self.known.joined(self.known.ids(chain.from_iterable(rows), n), starts)
        return starts, ends, totals, counts, sizes


def _counter(key: str, shared: Broadcast) -> Counter:
    """One counter for each Python worker and vocabulary."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(shared.value)
    return _COUNTERS[key]


_COUNTERS: dict = {}


def prefix_counts(docs: DataFrame, vocabulary: str, text: str = "text", *, limit: int | None = None) -> DataFrame:
    """docs with prefix_tokens (tokens of every prefix: element n is the count of the first n characters), unit_ends (byte offsets) and token_totals (tokens up to each); with a limit (0 or more), also n_bytes_kept, the bytes of the longest prefix of at most so many tokens. vocabulary: path of a byte-level BPE description in JSON."""
    description = Path(vocabulary).read_bytes()
    key, shared = xxhash.xxh64_hexdigest(description), docs.sparkSession.sparkContext.broadcast(description)
    fields = [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("prefix_tokens", "unit_ends", "token_totals")]
    fields += [T.StructField("n_bytes_kept", T.LongType())] if limit is not None else []

    def make():
        counter = _counter(key, shared)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [counter.units(x) for x in raw(batch.column(text))]
            starts, ends, totals, counts, sizes = counter.of_units(rows)
            kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
            at, each = pa.array(starts.astype(np.int32)), pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            out = [pa.ListArray.from_arrays(o, pa.array(x.astype(np.int32, copy=False)), type=kind) for o, x in ((each, counts), (at, ends), (at, totals))]
            if limit is not None:
                out.append(pa.array(counter.longest_prefixes(rows, starts, ends, totals, limit), pa.int64()))
            return out

        return run

    return append(docs, fields, make, text)


def n_tokens(counts: str = "prefix_tokens") -> Column:
    """Tokens of the whole text: those of its longest prefix (token_totals ends in the same number)."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("long")


def unit_prefix_counts(description: bytes, unit: str) -> list[int]:
    """Tokens of every prefix of one unit, by characters, the empty one first."""
    return Counter(description).unit_prefixes(unit.encode())[1]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", n_tokens().alias("n_tokens"), (n_tokens() > 512).alias("over_limit"), "n_bytes_kept")

"""Chat formatting by columnar assembly of bytes.

For many turns at once, the lengths of headers, texts and end marks are computed as arrays, their cumulative sums are the
offsets, and headers and texts are copied by scatter indices into one preallocated buffer, which becomes an Arrow column of
formatted pieces. Control strings in texts and roles are found by one search over all texts of a batch, and a backslash is set
after the first character of each; one that already has backslashes there gets one more, so taking one away undoes it. The loss
mask is a list of byte ranges, one for each text of the assistant.

Conversations are cut into pieces (`turns`), so one of any length is formatted by many tasks. Reading back runs where the pieces
are; only conversations that lie in more than one piece or may do so are sent on, to be digested in order by a stream.

Defined results: a null text or role is empty; turns are in order of (turn, role, text), nulls first, and equal rows are all
kept; rows under a null id are one conversation; texts may be of any length (a task holds some 2 MB of texts, or one text, and
scatter indices for a million bytes); an empty table gives an empty table; input columns besides the four are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .turns import cut, folded

#: Bytes whose scatter indices are held at once.
BLOCK = 1 << 20
_REST = bytes(range(0x80, 0xC0))
_SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
_PIECE = [T.StructField("n_turns", T.LongType()), T.StructField("body", T.StringType()), T.StructField("loss", T.ArrayType(_SPAN, False))]
_DIGEST = [T.StructField(n, T.LongType() if n.endswith(("s", "turns")) else T.StringType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]


@dataclass(frozen=True)
class Template:
    """A turn is start, role, a line end, text, end. others: control strings of other templates, which are escaped as well."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>")

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c or "\n" in c or any(c[k:].startswith(d) or d.startswith(c[k:]) for d in self.controls for k in range(1, len(c))):
                raise ValueError(f"{c!r} cannot be told apart in a text")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.end.rstrip("\n"), *self.others)

    def _pattern(self, slashes: str) -> re.Pattern[bytes]:
        firsts: dict[str, list[str]] = {}
        for c in self.controls:
            firsts.setdefault(c[0], []).append(re.escape(c[1:]))
        return re.compile("|".join(f"{re.escape(a)}{slashes}(?=({'|'.join(rest)}))" for a, rest in firsts.items()).encode())

    @cached_property
    def found(self) -> re.Pattern[bytes]:
        return self._pattern(r"\\*")

    @cached_property
    def escaped(self) -> re.Pattern[bytes]:
        return self._pattern(r"\\+")

    @cached_property
    def turn(self) -> re.Pattern[bytes]:
        return re.compile(re.escape(self.start.encode()) + rb"([^\n]*)\n(.*?)" + re.escape(self.end.encode()), re.DOTALL)

    def escape(self, text: bytes) -> bytes:
        return self.found.sub(lambda m: m[0][:1] + b"\\" + m[0][1:], text)

    def unescape(self, text: bytes) -> bytes:
        return self.escaped.sub(lambda m: m[0][:-1], text)

    def header(self, role: str) -> bytes:
        return self.start.encode() + self.escape(role.replace("\\", "\\\\").replace("\n", "\\n").encode()) + b"\n"

    def role(self, told: bytes) -> bytes:
        return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], self.unescape(told))

    def turns(self, body: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(role, text) of each turn of a formatted piece."""
        at = 0
        for m in self.turn.finditer(body):
            if m.start() != at:
                break
            at = m.end()
            yield self.role(m[1]), self.unescape(m[2])
        if at != len(body):
            raise ValueError(f"no turn at byte {at}")


def _ramps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns; the turns' offsets in it; where each text starts and ends."""
    n = len(texts)
    coded = pc.dictionary_encode(pc.fill_null(roles, ""))
    headers = [template.header(x) for x in coded.dictionary.to_pylist()] or [b""]
    code = coded.indices.to_numpy()
    sizes = np.array([len(x) for x in headers])
    blob, firsts = np.frombuffer(b"".join(headers), np.uint8), np.cumsum(sizes) - sizes
    texts = pc.fill_null(texts, "")
    _, offs, bytes_ = texts.buffers()
    off = np.frombuffer(offs, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = (np.frombuffer(bytes_, np.uint8) if bytes_ else np.zeros(0, np.uint8))[off[0] : off[-1]]
    off -= off[0]
    marks = [(m.start(), m.end(m.lastindex)) for m in template.found.finditer(memoryview(data))] if len(data) else []
    at = np.array(marks, np.int64).reshape(-1, 2)
    row = np.searchsorted(off, at[:, 0], "right") - 1
    slashes = at[at[:, 1] <= off[row + 1], 0] + 1  # not those over the end of a text
    before = np.searchsorted(slashes, off)
    long = np.diff(off) + np.diff(before)
    head, end = sizes[code], np.frombuffer(template.end.encode(), np.uint8)
    ends = np.cumsum(head + long + len(end))
    starts = ends - head - long - len(end)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    ramp = _ramps(head)
    out[np.repeat(starts, head) + ramp] = blob[np.repeat(firsts[code], head) + ramp]
    out[(ends - len(end))[:, None] + np.arange(len(end))] = end
    inside = starts + head
    cuts = np.unique(np.r_[off[:-1], slashes, np.arange(0, len(data), BLOCK)])
    cuts = cuts[cuts < len(data)]
    of = np.searchsorted(off, cuts, "right") - 1
    shift = inside[of] - off[of] + np.searchsorted(slashes, cuts, "right") - before[of]
    sizes_ = np.diff(np.r_[cuts, len(data)])
    if len(slashes):
        out[slashes + shift[np.searchsorted(cuts, slashes)] - 1] = ord("\\")
    for a in range(0, len(data), BLOCK):
        i, j = np.searchsorted(cuts, (a, a + BLOCK))
        b = min(a + BLOCK, len(data))
        out[np.arange(a, b) + np.repeat(shift[i:j], sizes_[i:j])] = data[a:b]
    return out, np.r_[starts, len(out)], inside, inside + long


def format_chats(conversations: DataFrame, template: Template = Template(), *, assistant: str = "assistant", most: int = 256, most_bytes: int = 1 << 18) -> DataFrame:
    """conv_id, part, at, alone, n_turns, body, loss: the formatted pieces of each conversation, in order of (part, at), with byte ranges of the loss mask in body. conversations: conv_id, turn, role, text."""

    def make() -> Callable[[pa.ListArray], list[pa.Array]]:
        def run(lists: pa.ListArray, alone: np.ndarray) -> list[pa.Array]:
            _, roles, texts = lists.values.flatten()
            rows = lists.offsets.to_numpy().astype(np.int64)
            out, at, first, end = assemble(roles, texts, template)
            bodies = at[rows]
            body = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(bodies.astype(np.int32)), pa.py_buffer(out)])
            taught = np.flatnonzero(pc.fill_null(pc.equal(roles, assistant), False).to_numpy(zero_copy_only=False))
            of = np.searchsorted(rows, taught, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array((x[taught] - bodies[of]).astype(np.int32)) for x in (first, end)], fields=[pa.field(f.name, pa.int32(), False) for f in _SPAN.fields])
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(taught, rows).astype(np.int32)), spans, type=pa.list_(pa.field("element", spans.type, False)))
            return [pa.array(np.diff(rows)), body, loss]

        return run

    near = F.substring("text", 1, 32)
    return cut(conversations.select("conv_id", "turn", "role", "text"), [F.col("turn"), F.col("role"), near], [F.col("turn"), F.col("role"), F.col("text")], _PIECE, make, most=most, most_bytes=most_bytes)


class _Read:
    """What is read back from the pieces of one conversation."""

    def __init__(self, template: Template) -> None:
        self.template, self.turns, self.taught = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss = self.chars = 0

    def add(self, body: str, loss: list[dict]) -> None:
        told = body.encode()
        for role, text in self.template.turns(told):
            self.turns.update(b"%b\n%b\n" % (role, text))
            self.n += 1
        for s in loss:
            text = self.template.unescape(told[s["start"] : s["end"]])
            self.taught.update(text)
            self.loss += len(text.translate(None, _REST))
        self.chars += len(body)

    def told(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.taught.hexdigest(), self.chars


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its formatted pieces."""
    return folded(pieces, ["body", "loss"], _DIGEST, lambda: _Read(template))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", mine), (-7, 1, "assistant", mine)], rows.schema)
    return read_back(format_chats(rows.unionByName(more)))


_STRINGS = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in Template().controls)
_BY = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), t AS (
  SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {_BY})) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' {_BY}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(r) + len(regexp_extract_all(r, '{_STRINGS}')) + len(regexp_extract_all(r, '[\\\n]')) + length(x) + len(regexp_extract_all(x, '{_STRINGS}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

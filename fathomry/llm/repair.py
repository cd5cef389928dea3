"""Repair of conversations by the lightest derivation.

Rows of a conversation are kept, rerolled, deleted or preceded by inserted ones, so that its roles read `(s?(ua)+)?`. This is a
weighted deduction: an item (i, state) says that the first i rows are settled with the roles told so far in that state; an edit of
row i is an axiom with its cost and letter; an item and an edit of its row derive the next item, and an insertion derives one of
the same row. Weights are pairs (cost, audit), added part by part; adding only grows them and keeps their order, so Knuth's agenda
pops each item first with its lightest weight, and ends when the goal, all rows settled after an assistant or none at all, is
popped. Ties of cost thus go to the ASCII-least audit.

Conversations are cut into pieces (`turns`). One that is whole in a piece is solved there. In others an item (state, state') of a
piece is derived for each pair of states: audits of one piece that end with the edit of its last row are never prefixes of each
other, so comparing them piece by piece compares the whole. Costs and ranks of a piece's items, at most 16, then decide which
items the conversation's derivation is made of; no task holds the rows of a long conversation. Rows that say what an earlier one
said are found by grouping digests of such conversations' rows.

Defined results: rows are in order of (turn, role, text), nulls first; a null role or text is one space, so a null text is blank;
equal rows are repeats of the first; rows under a null id are one conversation; a conversation whose rows are all marked as gone
has zeros, an empty audit and no rows; texts may be of any length (a task holds some 2 MB of texts, or one text); an empty table
gives an empty table; input columns besides the five are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACES, table, written
from .turns import cut, folded

#: Nothing told, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NOTHING, ASSISTANT)
#: What a kept row's initial leads to, from each state.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state that a row with a new role leads to, and the role.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType())])
_SAID = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_SOLVED = [T.StructField(n, T.LongType()) for n in ("distinct", "least", "most", *_COUNTS)] + [T.StructField(n, T.StringType()) for n in ("first", "last", "audit")] + [T.StructField("repaired", T.ArrayType(_SAID))]
_RESULT = [T.StructField(n, T.LongType()) for n in ("gaps", *_COUNTS)] + [T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")]
_STEPS = [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]


@dataclass(slots=True)
class Row:
    turn: int | None
    role: str
    text: str
    fault: str = ""


def judged(turns: list[dict], firsts: set[int] | None = None) -> list[Row]:
    """The rows of a piece that are not gone, with the first fault of each. firsts: places in the piece of rows that say what none before them said; None: the piece is a whole conversation."""
    rows, seen = [], set()
    for i, t in enumerate(turns):
        if t["gone"]:
            continue
        row = Row(t["turn"], t["role"], t["text"])
        said = (row.role, row.text)
        text = row.text.encode().strip(SPACES)
        if not text:
            row.fault = "blank"
        elif said in seen if firsts is None else i not in firsts:
            row.fault = "duplicate"
        elif text[-1:] not in b".!?":
            row.fault = "truncated"
        seen.add(said)
        rows.append(row)
    return rows


def edits(row: Row) -> list[tuple[int, str, Callable[[int], int | None]]]:
    """(cost, letter, state to state) of what may be done to a row."""
    delete = (DELETE, "D", lambda q: q)
    if row.fault in ("blank", "duplicate"):
        return [delete]
    more, initial = CUT if row.fault else 0, row.role[:1]
    return [delete, (more, "K", lambda q: KEEP[q].get(initial)), (REROLE + more, "R", lambda q: NEXT[q][0])]


def agenda(axioms: list[list[tuple[int, str, Callable[[int], int | None]]]], entry: int, closed: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """Lightest (cost, audit) of each item popped, from an entry state. closed: the goal ends it, and rows may be inserted after the last one; else all items are popped, and a derivation ends with an edit of the last row."""
    n, done = len(axioms), {}
    waiting = [(0, "", 0, entry)]
    while waiting:
        cost, audit, i, q = heapq.heappop(waiting)
        if (i, q) in done:
            continue
        done[i, q] = cost, audit
        if closed and i == n and q in GOALS:
            return done
        if i < n:
            for c, letter, move in axioms[i]:
                to = move(q)
                if to is not None and (i + 1, to) not in done:
                    heapq.heappush(waiting, (cost + c, audit + letter, i + 1, to))
        if (i < n or closed) and (i, NEXT[q][0]) not in done:
            heapq.heappush(waiting, (cost + INSERT, audit + "I", i, NEXT[q][0]))
    return done


def applied(rows: list[Row], audit: str, state: int = NOTHING) -> list[tuple[str, str]]:
    """(role, text) after the edits."""
    out, at = [], iter(rows)
    for e in audit:
        row = None if e == "I" else next(at)
        if e == "D":
            continue
        if e == "K":
            out.append((row.role, row.text))
            state = KEEP[state][row.role[:1]]
        else:
            state, role = NEXT[state]
            out.append((role, row.text if row else ""))
    return out


def summary(rows: list[Row], cost: int, audit: str, state: int = NOTHING) -> tuple:
    """The fields of a solved piece."""
    known = [r.turn for r in rows if r.turn is not None]
    initials = [r.role[:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    faults = [sum(r.fault == f for r in rows) for f in _COUNTS[:3]]
    ends = (initials[0], initials[-1]) if rows else (None, None)
    return (len(set(known)), min(known, default=None), max(known, default=None), *faults, illegal, cost, *ends, audit, [dict(zip(("role", "text"), x)) for x in applied(rows, audit, state)])


def _columns(rows: list[tuple], fields: list[T.StructField]) -> list[pa.Array]:
    kinds = to_arrow_schema(T.StructType(fields)).types
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def _mapped(df: DataFrame, fields: list[T.StructField], one: Callable[..., tuple], *taken: str) -> DataFrame:
    """conv_id, part, at and what one() makes of the columns taken of each row."""
    schema = T.StructType([*(df.schema[c] for c in ("conv_id", "part", "at")), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(*x) for x in zip(*[(v.as_py() for v in batch.column(c)) for c in taken])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "at")), *_columns(made, fields)], names=schema.names)

    return df.select("conv_id", "part", "at", *taken).mapInArrow(run, schema)


def steps(turns: list[dict], firsts: list[int] | None) -> tuple[list[int | None], list[str | None]]:
    """Costs and audits of a piece's items, at 4 * entry + exit."""
    rows = judged(turns, set(firsts or ()))
    axioms, costs, audits = [edits(r) for r in rows], [None] * 16, [None] * 16
    for entry in range(4):
        for (i, q), (cost, audit) in agenda(axioms, entry, False).items():
            if i == len(rows):
                costs[4 * entry + q], audits[4 * entry + q] = cost, audit
    return costs, audits


#: Rows to insert after the last one, by the state it leaves.
_TAIL = np.array([0, 2, 1, 0])


def chosen(costs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of each piece of a conversation the item (4 * entry + exit) that its lightest derivation is made of. costs, ranks: pieces x 4 x 4; a cost that is none is infinite."""
    n = len(costs)
    ahead = np.empty((n + 1, 4))
    ahead[n] = INSERT * _TAIL
    for k in range(n - 1, -1, -1):
        ahead[k] = (costs[k] + ahead[k + 1]).min(axis=1)
    out, q = np.empty(n, np.int64), NOTHING
    for k in range(n):
        light = costs[k, q] + ahead[k + 1] == ahead[k, q]
        to = int(np.where(light, ranks[k, q], 99).argmin())
        out[k], q = 4 * q + to, to
    return out


def _choose(t: pa.Table) -> pa.Table:
    t = t.sort_by([("part", "ascending"), ("at", "ascending")])
    costs = np.array([[np.inf if c is None else c for c in x] for x in t.column("costs").to_pylist()]).reshape(-1, 4, 4)
    ranks = np.array(t.column("ranks").to_pylist()).reshape(-1, 4, 4)
    last = np.arange(len(costs)) == len(costs) - 1
    return pa.table([*(t.column(c) for c in ("conv_id", "part", "at")), pa.array(chosen(costs, ranks).astype(np.int32)), pa.array(last)], names=["conv_id", "part", "at", "item", "last"])


def repair(conversations: DataFrame, *, most: int = 256, most_bytes: int = 1 << 18) -> DataFrame:
    """conv_id, part, at, alone, counts of the piece (distinct, least, most: of its turns; blank, duplicate, truncated, illegal, cost), its first and last initial, audit and repaired rows; pieces of a conversation are in order of (part, at). conversations: conv_id, turn, role, text, gone."""
    said = F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *said, F.coalesce("gone", F.lit(False)).alias("gone"))

    def make() -> Callable[[pa.ListArray, np.ndarray], list[pa.Array]]:
        def run(lists: pa.ListArray, alone: np.ndarray) -> list[pa.Array]:
            out = []
            for x, whole in zip(lists, alone):
                if whole:
                    mine = judged(x.as_py())
                    done = agenda([edits(r) for r in mine], NOTHING, True)
                    out.append((*summary(mine, *min(done[g] for q in GOALS if (g := (len(mine), q)) in done)), None))
                else:
                    out.append((*(None,) * len(_SOLVED), x.as_py()))
            return _columns(out, fields)

        return run

    fields = [*_SOLVED, T.StructField("rows", T.ArrayType(_TURN))]
    order = [F.col(c) for c in ("turn", "role", "text")]
    found = written(cut(rows, [*order[:2], F.substring("text", 1, 32)], order, fields, make, most=most, most_bytes=most_bytes), "repaired")
    key = ["conv_id", "part", "at"]
    names = [f.name for f in _SOLVED]

    open_ = found.where(F.col("rows").isNotNull()).select(*key, "rows")
    spoken = open_.select(*key, F.posexplode("rows").alias("i", "r")).where("not r.gone")
    digest = F.md5(F.concat_ws(":", F.length("r.role").cast("string"), "r.role", "r.text"))
    firsts = spoken.groupBy("conv_id", digest.alias("d")).agg(F.min(F.struct("part", "at", "i")).alias("f"))
    firsts = firsts.groupBy("conv_id", "f.part", "f.at").agg(F.collect_list("f.i").alias("firsts"))  # no more than a piece has rows
    solved = written(_mapped(_beside(open_, firsts, "firsts"), [*_STEPS, T.StructField("rows", T.ArrayType(_TURN)), T.StructField("firsts", T.ArrayType(T.IntegerType()))], lambda r, f: (*steps(r, f), r, f), "rows", "firsts"), "steps")
    ranks = F.transform("audits", lambda a: F.coalesce(F.array_position(F.array_sort(F.array_distinct("audits")), a), F.lit(99)))
    light = solved.select(*key, "costs", ranks.alias("ranks"))
    items = light.groupBy("conv_id").applyInArrow(_choose, T.StructType([*(found.schema[c] for c in key), T.StructField("item", T.IntegerType()), T.StructField("last", T.BooleanType())]))

    def finish(turns: list[dict], before: list[int] | None, costs: list[int | None], audits: list[str | None], item: int, last: bool) -> tuple:
        tail = int(_TAIL[item % 4]) if last else 0
        return summary(judged(turns, set(before or ())), costs[item] + INSERT * tail, audits[item] + "I" * tail, item // 4)

    done = _mapped(_beside(solved, items, "item", "last"), _SOLVED, finish, "rows", "firsts", "costs", "audits", "item", "last")
    whole = found.where(F.col("rows").isNull()).select(*key, F.lit(True).alias("alone"), *names)
    return whole.unionByName(done.select(*key, F.lit(False).alias("alone"), *names))


def _beside(pieces: DataFrame, more: DataFrame, *names: str) -> DataFrame:
    """pieces with columns of another table of pieces, null where it has none."""
    other = more.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), F.col("at").alias("__a"), *names)
    return pieces.join(other, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")) & (F.col("at") == F.col("__a")), "left").drop("__c", "__p", "__a")


class _Told:
    """Counts and digest of one conversation."""

    def __init__(self) -> None:
        self.counts, self.distinct, self.least, self.most = dict.fromkeys(_COUNTS, 0), 0, None, None
        self.last, self.audit, self.hash, self.any = None, [], hashlib.sha256(), False

    def add(self, distinct: int, least: int | None, most: int | None, first: str | None, last: str | None, audit: str, repaired: list[dict], **counts: int) -> None:
        for c in _COUNTS:
            self.counts[c] += counts[c]
        if first is not None:
            self.counts["illegal"] += self.last is not None and self.last + first not in ("su", "ua", "au")
            self.last = last
        if least is not None:
            self.distinct += distinct - (least == self.most)
            self.least, self.most = least if self.least is None else self.least, most
        self.audit.append(audit)
        for r in repaired:
            self.hash.update(b"\n" * self.any + f"{r['role']}:{r['text']}".encode())
            self.any = True

    def told(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return gaps, *self.counts.values(), "".join(self.audit), self.hash.hexdigest()


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, from its repaired pieces."""
    return folded(pieces, [f.name for f in _SOLVED], _RESULT, _Told)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each row damaged, or not, by a hash of its conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


def _told(q: str, more: str, letter: str, out: str = "") -> str:
    """A state's derivation with one more edit."""
    said = f"{q}.o" if not out else f"{q}.o || CASE WHEN {q}.n > 0 THEN chr(10) ELSE '' END || {out}"
    return f"{{'c': {q}.c + {more}, 'a': {q}.a || '{letter}', 'n': {q}.n + {1 if out else 0}, 'o': {said}}}"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


_NONE = "{'c': 1000000000, 'a': '', 'n': 0, 'o': ''}"
_KEPT, _UT, _AT = "role || ':' || text", "'user:'", "'assistant:'"


def _row(state: str, before: list[str], initial: str, name: str) -> str:
    """What leads to a state by an edit of a row; before: the states in which it may be kept or rerolled."""
    free = "fault IN ('', 'truncated')"
    found = [_told(state, "4", "D")]
    for q in before:
        found.append(f"CASE WHEN {free} AND role[1] = '{initial}' THEN {_told(q, '3 * late', 'K', _KEPT)} ELSE {_NONE} END")
        if name:
            found.append(f"CASE WHEN {free} THEN {_told(q, '3 + 3 * late', 'R', f'{name} || text')} ELSE {_NONE} END")
    return _least(*found)


ORACLE = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda r, b:
    list_reduce(list_prepend(xor(r, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, generate_series(1, 2) AS g(i) WHERE kind <> 0 AND (i = 1 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 'truncated' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, count(*) OVER (PARTITION BY conv_id) AS size FROM o
), s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'n': 0, 'o': ''}} AS q0, {_NONE} AS qs, {_NONE} AS qu, {_NONE} AS qa FROM conversations
  UNION ALL
  SELECT conv_id, i, {_told("q0", "4", "D")}, {_row("qs", ["q0"], "s", "")}, {_row("qu", ["q0", "qs", "qa"], "u", _UT)}, {_row("qa", ["qu"], "a", _AT)} FROM (
    SELECT s.conv_id, f.i, role, text, fault, (fault = 'truncated')::INT AS late, q0, qs, qu, {_least("qa", _told("qu", "3", "I", _AT))} AS qa FROM (
      SELECT conv_id, i, q0, qs, qa, {_least("qu", *(_told(q, "3", "I", _UT) for q in ("q0", "qs", "qa")))} AS qu FROM s) AS s
    JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)
), e AS (
  SELECT conv_id, {_least("q0", "qa", _told("qu", "3", "I", _AT))} AS best FROM (
    SELECT s.conv_id, q0, qa, {_least("qu", *(_told(q, "3", "I", _UT) for q in ("q0", "qs", "qa")))} AS qu
    FROM s LEFT JOIN (SELECT DISTINCT conv_id, size FROM f) AS z ON z.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(z.size, 0))
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256 FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

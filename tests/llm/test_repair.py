import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import pytest

from fathomry.llm import repair
from fathomry.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int, cost string, gone boolean"
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(c, t, role, text):
    """What is left of a row, once or twice or not at all."""
    show = lambda v: " " if v is None else str(v)
    role, text, h = show(role), show(text), zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return [(t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def plain(rows):
    """The result for rows (turn, role, text), by recursion from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(i, told, inserted):
        """(cost, audit, rows) to settle what is left after rows whose last initial is told."""
        found = [(0, "", ())] if i == len(rows) and told in ("", "a") else []
        new = "a" if told == "u" else "u"
        role = {"a": "assistant", "u": "user"}[new]
        if inserted < 3:
            c, e, r = best(i, new, inserted + 1)
            found.append((c + 3, "I" + e, ((role, ""), *r)))
        if i < len(rows):
            c, e, r = best(i + 1, told, 0)
            found.append((c + 4, "D" + e, r))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                kept = MOVES.get((told, rows[i][1][:1]))
                if kept:
                    c, e, r = best(i + 1, kept, 0)
                    found.append((c + more, "K" + e, (rows[i][1:], *r)))
                c, e, r = best(i + 1, new, 0)
                found.append((c + 3 + more, "R" + e, ((role, rows[i][2]), *r)))
        return min(found) if found else (10**9, "", ())

    cost, audit, left = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    told = "\n".join(f"{r}:{t}" for r, t in left)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()


def some(n, seed=1):
    """Conversations with nulls in every column, ties, repeats, faults and columns named like outputs."""
    r, out = random.Random(seed), []
    for c in range(n):
        roles = r.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "tool", "", None, "User"]])
        for t in range(r.randint(1, 12)):
            turn = r.choice([t, t, t, t, t + 1, 2 * t, None])
            text = r.choice(["Yes.", "No!", "why", "Well, é?", "", " \n", None, f"Line {t}.", f"line {t}", "ok.\t "])
            out.append((c if c else None, turn, roles[t % len(roles)] if r.random() < 0.7 else r.choice(roles), text, "x", 1, "y", r.random() < 0.1))
    return out


def grouped(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).extend(rest)
    return out


@pytest.mark.parametrize("most, most_bytes", [(256, 1 << 18), (1, 1 << 18), (3, 20)])
def test_repair_equals_recursion_for_pieces_of_any_size(spark, most, most_bytes):
    rows = some(150) + [(500, 0, "user", "gone.", None, None, None, True)]
    want = grouped((c, *([] if gone else [(t, " " if role is None else role, " " if text is None else text)])) for c, t, role, text, *_, gone in rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = repair.digests(repair.repair(df, most=most, most_bytes=most_bytes)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain(x) for c, x in want.items()} and len(found) == len(want)
    assert next(tuple(r)[1:] for r in found if r.conv_id == 500) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_recursion(spark, tmp_path):
    rows = [r[:4] for r in some(300, 7)]
    spark.createDataFrame(rows, SCHEMA.rsplit(", ", 4)[0]).write.parquet(f"{tmp_path}/conversations.parquet")
    want = grouped((r[0], *damage(*r)) for r in rows)
    found = QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain(x) for c, x in want.items()} and len(found) == len(want)
    assert len({e for r in found for e in r.audit}) == 4


def test_query_equals_sql(spark, tmp_path):
    rows = [r[:4] for r in some(120, 11)]
    spark.createDataFrame(rows, SCHEMA.rsplit(", ", 4)[0]).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(repair.ORACLE)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()), key=repr) == want


def test_query_on_given_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = grouped((r[0], *damage(*r)) for r in rows)
    found = QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain(x) for c, x in want.items()}


def test_a_long_conversation_lies_in_many_pieces(spark):
    r = random.Random(2)
    rows = [(9, i, r.choice(["user", "assistant"]), r.choice(["a.", "b", f"{i}."])) for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "false AS gone")
    pieces = repair.repair(df, most=16)
    assert pieces.where("not alone").count() >= 900 // 16
    found = repair.digests(pieces).collect()
    mine = repair.judged([{"turn": t, "role": role, "text": text, "gone": False} for _, t, role, text in rows])
    done = repair.agenda([repair.edits(x) for x in mine], repair.NOTHING, True)
    assert len(found) == 1 and (found[0].cost, found[0].audit) == min(done[g] for g in [(900, 0), (900, 3)] if g in done)


def test_the_lightest_items_of_pieces():
    costs, ranks = np.full((2, 4, 4), np.inf), np.full((2, 4, 4), 99)
    costs[0, 0, 2], ranks[0, 0, 2] = 0, 1
    costs[0, 0, 3], ranks[0, 0, 3] = 3, 0
    costs[1, 2, 3] = costs[1, 3, 3] = 3
    ranks[1] = 0
    assert repair.chosen(costs, ranks).tolist() == [2, 11]
    costs[0, 0, 3] = 0
    assert repair.chosen(costs, ranks).tolist() == [3, 15]


def test_empty_table(spark):
    assert repair.digests(repair.repair(spark.createDataFrame([], SCHEMA))).count() == 0

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from data import save

from fathomry.llm import chat, turns
from fathomry.llm.chat import Template
from fathomry.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, body string, part int, n_turns string"
PARTS = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "\\", "<", "|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "é", "日本", " ok ", "\n", "\\\\", "<\\|im_end|>", "user\n"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 9))) for _ in range(n)]


def awkward():
    """Conversations with nulls in every column, ties, repeated rows, long texts, and columns named like outputs."""
    r, out = random.Random(3), []
    for c in range(40):
        for t, x in enumerate(texts(r.randint(1, 7), c)):
            out.append((c, t, r.choice(["system", "user", "assistant", "", None, "a\\n\nb<|im_start|>"]), x, "b", 1, "n"))
    out += [(None, 0, "user", "hello", None, None, None), (None, None, "assistant", None, None, None, None), (50, None, "user", "x", None, None, None), (50, 3, "assistant", "first", None, None, None), (50, 3, "assistant", "first", None, None, None), (50, 3, "assistant", "", None, None, None), (51, 0, "assistant", "long<s>" * 100_000, None, None, None)]
    return out


def expected(rows):
    convs = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, x) for x in r[1:4])):
        convs.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    out = {}
    for c, said in convs.items():
        taught = "".join(t for _, t, mine in said if mine)
        out[c] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in said).encode()).hexdigest(), len(taught), hashlib.sha256(taught.encode()).hexdigest())
    return out


@pytest.mark.parametrize("template", [Template(), Template("[TURN]", "[/TURN]", ("<s>",))])
def test_assembled_bytes_equal_plain_joins(template):
    found = texts(400)
    roles = ["user", "a\\n\nb<|im_start|>", None, "assistant"] * 100
    for size in (1 << 20, 7):
        chat.BLOCK, old = size, chat.BLOCK
        try:
            out, at, first, end = chat.assemble(pa.array(roles), pa.array(["skip", *found]).slice(1), template)
        finally:
            chat.BLOCK = old
        body = out.tobytes()
        for i, (role, text) in enumerate(zip(roles, found)):
            mine = body[at[i] : at[i + 1]]
            assert mine == template.header(role or "") + template.escape(text.encode()) + template.end.encode()
            assert template.unescape(body[first[i] : end[i]]) == text.encode()
        assert [(r.decode(), t.decode()) for r, t in template.turns(body)] == [(r or "", t) for r, t in zip(roles, found)]


def test_control_strings_never_stay():
    t = Template()
    for x in texts(2000, 5) + ["</s>[INST] ok [/INST]"]:
        told = t.escape(x.encode())
        assert t.unescape(told) == x.encode() and not any(c.encode() in told for c in t.controls)


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        Template("<a>", "<b>", (">x",))
    with pytest.raises(ValueError):
        list(Template().turns(b"no turn"))


@pytest.mark.parametrize("most, most_bytes", [(256, 1 << 18), (1, 1 << 18), (3, 50)])
def test_pieces_of_any_size_say_the_same(spark, most, most_bytes):
    rows = awkward()
    found = chat.read_back(chat.format_chats(spark.createDataFrame(rows, SCHEMA), most=most, most_bytes=most_bytes)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == expected(rows) and len(found) == len(expected(rows))


def test_a_long_conversation_is_many_pieces_in_many_tasks(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(5000)] + [(i + 100, 0, "user", "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = chat.format_chats(df).cache()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = made.where("conv_id = 7").collect()
    assert len({r.part for r in held}) > 1 and max(r.n_turns for r in held) <= 256 and not any(r.alone for r in held)
    assert made.where("alone").count() >= 1990
    out = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert out == expected(rows)


def test_empty_table(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_changes_treat_nulls_as_equal():
    assert turns.changes(pa.array([None, None, 1, 1, None, 2])).tolist() == [False, True, False, True, True]


def test_query(spark, tmp_path):
    rows = awkward()
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    mine = "</s>[INST] ok [/INST]"
    want = expected([*rows, (-7, 0, "user", mine), (-7, 1, "assistant", mine)])
    found = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, path).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == want
    t = Template()
    assert found[-7].formatted_chars == sum(len(t.header(r) + t.escape(mine.encode()) + t.end.encode()) for r in ("user", "assistant"))


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(awkward(), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(chat.ORACLE)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES["op11_chat_format"](spark, str(tmp_path)).collect()), key=repr) == want

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from data import TEXTS, documents, prose, rows, save

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from fathomry.llm import encode, lexicon, token_counts  # noqa: E402
from fathomry.llm.bpe import Merges  # noqa: E402

WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
WHITE = "\t\n \x85\xa0        　"
ODD = ["", "  ", " a", "a ", "a  b", "a \nb", "don't stop", "ΣΑΣ İ ẞ ﬁ", "é ́", "a\x1cb\x85c\xa0 d", "<|endoftext|>", "x<|endoftext|> y <|startoftext|>", "﷐a ﷑", "a​b", "w" * 200 + " v", "日本 語。", "a b", "!<|endoftext|>　we're Ᲊ ՘x", *(f"a{w}b{w}{w}c" for w in WHITE)]


def unicode_texts(seed=4, n=4000):
    """Random texts rich in white space, letters of newer tables, marks and special strings."""
    r = random.Random(seed)
    pool = [*WHITE, *"abzAZ09'!?.", "'s", "'re", "é", "́", "ß", "Σ", "日", "՘", "࢏", "Ɤ", "\U00010d50", "\U00016ea0", "\U0001f600", "٣", "Ⅷ", "<|endoftext|>", "<|", "\x1c", "​", "﷐"]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 24))) for _ in range(n)]


def test_encode_equals_the_library(spark, sf):
    lib = tokenizers.Tokenizer.from_file(WORD)
    out = encode.digests(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out.collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def same_as_the_library(texts, lexicon=None):
    lib, mine = tokenizers.Tokenizer.from_file(WORD), encode.Encoder(open(WORD, "rb").read(), lexicon)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    ends, flat = mine.encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert mine.decode(ends, flat).to_pylist() == [lib.decode(ids, skip_special_tokens=False) for ids in want]


def test_words_on_odd_texts():
    same_as_the_library([t or "" for t in TEXTS] + ODD + unicode_texts())


def test_words_on_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same_as_the_library([f"{c} a{c}b 1{c}!" for c in points[:0x3000]] + [" ".join(f"{c} a{c}b" for c in points[k : k + 64]) for k in range(0x3000, len(points), 64)])


def test_a_table_that_overflows_and_a_lexicon(monkeypatch, tmp_path):
    texts = prose() + ODD
    words = sorted({w.encode() for t in texts for w in t.split()[::3] if "<|" not in w and w.isascii()})
    made = encode.Encoder(open(WORD, "rb").read(), None).merged(words)
    lexicon.compile_words(words, [np.frombuffer(x, "<u4").astype(np.int32) for x in made]).tofile(tmp_path / "x.bin")
    monkeypatch.setattr(encode, "REMEMBERED", 40)
    lib, mine = tokenizers.Tokenizer.from_file(WORD), encode.Encoder(open(WORD, "rb").read(), str(tmp_path / "x.bin"))
    for t in texts:
        assert mine.encode(pa.array([t]))[1].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_frequent_words(spark):
    docs = spark.createDataFrame([("the the cat",), ("the dog\nthe",), (None,), ("",)], "text string")
    assert encode.frequent_words(docs, min_share=0.5) == [b"the"]
    assert encode.frequent_words(docs, min_share=0.01) == [b"cat", b"dog", b"the"]
    assert encode.frequent_words(docs.limit(0)) == []


def test_counts_equal_the_library():
    texts = [t or "" for t in TEXTS] + ODD + unicode_texts(5, 1500)
    lib, mine = tokenizers.Tokenizer.from_file(BYTE), token_counts.Counter(open(BYTE, "rb").read())
    starts, ends, totals = mine.prefixes([t.encode() for t in texts])
    for i, t in enumerate(texts):
        row = slice(starts[i], starts[i + 1])
        for end, total in zip(ends[row].tolist()[:50], totals[row].tolist()):
            assert total == len(lib.encode(t.encode()[:end].decode(), add_special_tokens=False).ids)
        assert (totals[row][-1] if starts[i + 1] > starts[i] else 0) == len(lib.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("unit", [" unbelievable's123", "   x", "\n\n\t", "x" * 120, "'re'd'", "日本語テキスト", "!<|endoftext|>a", "　 we're", "aaaa'''bbb111", *{u for t in unicode_texts(6, 60) for u in [t.replace("﷐", "")] if u}])
def test_every_prefix_of_a_unit(unit):
    lib, counter = tokenizers.Tokenizer.from_file(BYTE), token_counts.Counter(open(BYTE, "rb").read())
    for u in counter.units(unit.encode()):
        u = u.decode()
        assert counter.unit_prefixes(u.encode())[1] == [len(lib.encode(u[:i], add_special_tokens=False).ids) for i in range(len(u) + 1)]


@pytest.mark.parametrize("unit", ["x" * 200, "<|endoftext|>", "<|endoftext|><|endoftext|>ab<|endoftext|>", "ab<|endof<|endoftext|>", " a<|endoftext|>'s12日本<|endoftext", " " * 90 + "y", "日本語" * 30, "a1!" * 40])
def test_prefixes_up_to_a_budget(unit):
    lib, counter = tokenizers.Tokenizer.from_file(BYTE), token_counts.Counter(open(BYTE, "rb").read())
    want = [len(lib.encode(unit[:i], add_special_tokens=False).ids) for i in range(len(unit) + 1)]
    assert counter.unit_prefixes(unit.encode())[1] == want
    for most in (0, 1, 2, 5, 17, 60, 1000):
        at, counts = counter.unit_prefixes(unit.encode(), most)
        best = max(i for i, n in enumerate(want) if n <= most)
        assert max(e for e, n in zip(at, counts) if n <= most) == len(unit[:best].encode())


@pytest.mark.parametrize("special", ["", "<|endoftext|>"])
def test_long_unbroken_texts_take_little_time(special):
    r = random.Random(1)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(1_000_000))
    text = special + text[:400] + special + text[400:] + special
    counter = token_counts.Counter(open(BYTE, "rb").read())
    start = time.perf_counter()
    (starts, ends, totals), rows = counter.prefixes([text.encode()]), [counter.units(text.encode())]
    (kept,) = counter.longest_prefixes(rows, starts, ends, totals, 512)
    assert time.perf_counter() - start < 8
    lib = tokenizers.Tokenizer.from_file(BYTE)
    n = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in (kept, *range(kept + 1, kept + 200))]
    assert n[0] <= 512 and min(n[1:]) > 512


def brute_kept(lib, text, limit):
    """Bytes of the longest prefix of at most `limit` tokens, from the long end."""
    for i in range(len(text), -1, -1):
        if len(lib.encode(text[:i], add_special_tokens=False).ids) <= limit:
            return len(text[:i].encode())


def test_the_longest_prefix(spark):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    texts = [None, *ODD, "one\nword\na\nline\n" * 3, "unbroken" * 9, "日本語のテキスト" * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for limit in (0, 1, 5):
        for r in token_counts.prefix_counts(docs, BYTE, limit=limit).collect():
            assert r.n_bytes_kept == brute_kept(lib, texts[r.doc_id] or "", limit)


def test_counts_at_every_prefix_are_stored(spark):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    texts = [None, *ODD, *unicode_texts(8, 300), "a1!" * 40, "\n\n \n" * 9 + "end", "日本語 'tis we're'" * 5, "\ufdd0 a\ufdd0 <|endoftext|><|endof"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in token_counts.prefix_counts(docs, BYTE).collect():
        t = texts[r.doc_id] or ""
        assert r.prefix_tokens == [len(e.ids) for e in lib.encode_batch([t[:i] for i in range(1, len(t) + 1)], add_special_tokens=False)]
        assert (r.prefix_tokens or [0])[-1] == (r.token_totals or [0])[-1]


def test_words_are_counted_by_the_recurrence_alone(monkeypatch):
    counter = token_counts.Counter(open(BYTE, "rb").read())
    counter.merges.keep(-1, 0)  # reads the rules
    monkeypatch.setattr(counter.merges, "merge", None)
    lib = tokenizers.Tokenizer.from_file(BYTE)
    texts = prose() + ["x" * 200 + " y", "日本語テキスト" * 9, "we're don't"]
    starts, ends, totals, counts, sizes = counter.of_units([counter.units(t.encode()) for t in texts])
    assert sizes.tolist() == list(map(len, texts))
    assert counts[np.cumsum(sizes) - 1].tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pairs_of_tokens_that_merging_keeps():
    merges, r = Merges(open(BYTE, "rb").read()), random.Random(3)
    short = [t for t, b in merges.bytes_of.items() if len(b) <= 3]
    pairs = [(r.choice(some), r.choice(some)) for some in (short, list(merges.bytes_of)) for _ in range(3000)]
    flat, starts = merges.merge([merges.bytes_of[a] + merges.bytes_of[b] for a, b in pairs])
    assert [merges.keep(a, b) for a, b in pairs] == [tuple(flat[i:j].tolist()) == p for p, i, j in zip(pairs, starts.tolist(), starts[1:].tolist())]


def test_what_is_forgotten_is_counted_again(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    lib, counter = tokenizers.Tokenizer.from_file(BYTE), token_counts.Counter(open(BYTE, "rb").read())
    for t in prose() + ODD:
        counts = counter.of_units([counter.units(t.encode())])[3]
        assert counts[-1:].tolist() == [len(lib.encode(t, add_special_tokens=False).ids)] * bool(t)


def test_the_counting_query(spark, sf):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = token_counts.op10_token_counts(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id]
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
        assert r.n_bytes_kept == len(t.encode()) if n <= 512 else len(lib.encode(t.encode()[: r.n_bytes_kept].decode(), add_special_tokens=False).ids) <= 512 < len(lib.encode(t.encode()[: r.n_bytes_kept + 40].decode(errors="ignore"), add_special_tokens=False).ids)


def test_the_counting_query_on_awkward_rows(spark, tmp_path):
    out = token_counts.op10_token_counts(spark, save(spark, tmp_path, documents(spark))).collect()
    lib = tokenizers.Tokenizer.from_file(BYTE)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want


def test_lexicon_shares_suffixes_and_numbers_words(tmp_path):
    words = sorted({w.encode() for t in prose() for w in t.split()} | {b"nation", b"station", b"stations"})
    merges = Merges(open(WORD, "rb").read())
    flat, starts = merges.merge(words)
    compiled = lexicon.compile_words(words, [flat[a:b] for a, b in zip(starts, starts[1:])])
    compiled.tofile(tmp_path / "x.bin")
    found = lexicon.Lexicon(str(tmp_path / "x.bin"))
    assert found.find(words).tolist() == list(range(len(words)))
    assert found.find([b"", b"natio", b"nationz", b"zz"]).tolist() == [-1] * 4
    assert len(found.ends) < len({w[:i] for w in words for i in range(len(w) + 1)})
    assert (lexicon.compile_words([], [])[:3] == [0, 1, 0]).all()


def test_awkward_rows(spark):
    docs = documents(spark).selectExpr("*", "1 as decoded", "2 as unit_ends", "3 as token_totals")
    lib = tokenizers.Tokenizer.from_file(WORD)
    out = encode.encode(docs, WORD, back=True).collect()
    want = sorted((str(r[0]), lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in out) == want and all(len(r.ids) == 4 * r.n_tokens for r in out)
    again = encode.decode(encode.encode(docs, WORD), WORD).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in out)
    counted = token_counts.prefix_counts(docs, BYTE)
    assert counted.select("*", token_counts.n_tokens().alias("t")).count() == len(rows())
    assert token_counts.prefix_counts(docs.limit(0), BYTE).count() == 0
    assert encode.encode(docs.limit(0), WORD).count() == 0

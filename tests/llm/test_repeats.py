import hashlib
import random

import numpy as np
import pytest
from data import documents, prose, rows

from fathomry.llm import repeats, substrings, subtrees, suffix_array
from fathomry.llm.anchors import of_bytes, of_words, runs


def brute(docs, symbols, length, same_doc):
    """Removed symbols of each document, as a list of flags, by a table of all windows. Different texts under one id are different documents, neither earlier."""
    first, own = {}, {}
    split = [(d if d is not None else -(2**63), t, symbols((t or "").encode())) for d, t in docs]
    for d, t, s in split:
        for i in range(len(s) - length + 1):
            w = s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
            first[w] = min(first.get(w, d), d)
            own.setdefault((d, t, w), i)
    out = []
    for d, t, s in split:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            w = s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
            if first[w] < d or (same_doc and own[d, t, w] < i):
                gone[i : i + length] = [True] * length
        out.append((s, gone))
    return out


def summary(s, gone):
    if isinstance(s, bytes):
        kept = bytes(b for b, g in zip(s, gone) if not g)
    else:
        kept = b" ".join(w for w, g in zip(s, gone) if not g)
    spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
    return len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def got(df):
    return sorted((str(r.doc_id), r.n_symbols, r.n_removed, r.n_spans, hashlib.sha256(r.kept or b"").hexdigest()) for r in df.collect())


def want(docs, symbols, length, same_doc):
    return sorted((str(d), *summary(*x)) for (d, _), x in zip(docs, brute(docs, symbols, length, same_doc)))


def word_list(t):
    return t.split()


def cases():
    r = random.Random(5)
    yield [(i, t) for i, t in enumerate(prose())]
    yield [(r.randrange(40), "".join(r.choice("ab ") for _ in range(r.randint(0, 90)))) for _ in range(60)]
    yield [(i, "x" * (30 + i % 3) + "tail" * (i % 5)) for i in range(12)]
    same = [(3, "one two three four five six seven eight nine ten " * 3), (3, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine ten")]
    yield same
    yield [r_[:2] for r_ in rows() if len(r_[1] or "") < 5000]
    texts = prose(250, 8)
    yield [(None if i % 3 else i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, texts[7])]
    yield [(7, t) for t in texts] + [(5, texts[3]), (7, texts[11])]
    yield [(1, "A " + texts[20]), (2, "A " + texts[20]), (2, "B " + texts[20])]
    shared = " ".join(texts[30].split()[:30])
    yield [(i, f"{texts[i % 90][:40]} {i}{chr(97 + i % 26)} {shared} {chr(97 + i % 7)}{i} {texts[i % 70][-40:]}") for i in range(220)]


@pytest.mark.parametrize("case,group", [(c, 1024) for c in range(9)] + [(0, 6), (6, 6), (8, 6)])
def test_equals_brute_force(spark, case, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = list(cases())[case]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(suffix_array.dedup(df, length=20)) == want(docs, bytes, 20, True)
    assert got(substrings.dedup(df, length=4)) == want(docs, word_list, 4, False)


def test_queries_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    a = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.op8_suffix_array(spark, sf).collect())
    assert a == want(docs, bytes, 100, True)
    b = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op5_substring_dedup(spark, sf).collect())
    assert b == [(w[0], w[1], w[2], w[4]) for w in want(docs, word_list, 13, False)]


@pytest.mark.parametrize("symbols_of", [of_bytes, of_words])
def test_runs_reach_every_window(symbols_of):
    texts = [t.encode() for t in prose()] + [b"", b"a a a a a a a a a a a a a a a", b"abc"]
    s = symbols_of(texts)
    r = runs(s, 9, 4)
    seen = [(t, f + i) for t, f, n in zip(r.text, r.first, r.count) for i in range(n)]
    assert seen == [(t, i) for t in range(len(texts)) for i in range(s.edges[t + 1] - s.edges[t] - 8)]
    assert all(f <= a and a + 4 <= f + 9 + n - 1 for f, a, n in zip(r.first, r.anchor, r.count))


@pytest.mark.parametrize("same_doc", [False, True])
def test_stream_does_not_depend_on_batches(same_doc):
    r = random.Random(9)
    data = sorted((r.randrange(6), r.randrange(3), r.randrange(4), r.randrange(2), r.randrange(5) << 32) for _ in range(200))
    cols = [np.array(c, np.int64) for c in zip(*data)]
    whole = repeats.Stream(same_doc, True).take(cols)
    for size in (1, 3, 50):
        stream = repeats.Stream(same_doc, True)
        parts = [stream.take([c[i : i + size] for c in cols]) for i in range(0, 200, size)]
        assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*parts)))) == sorted(zip(*(x.tolist() for x in whole)))


@pytest.mark.parametrize("width,head", [(5, False), (5, True), (0, True)])
def test_order_and_common_prefixes(width, head):
    r = np.random.default_rng(3)
    rows_, of = r.integers(0, 3, (80, width)).astype(np.uint16), r.integers(0, 4, 80) if head else None
    order, common = subtrees.ordered(rows_, of)
    keys = [((int(of[i]),) if head else ()) + tuple(rows_[i].tolist()) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 80):
        a, b = rows_[order[i - 1]], rows_[order[i]]
        same = next((j for j in range(width) if a[j] != b[j]), width)
        assert common[i] == (-1 if head and of[order[i - 1]] != of[order[i]] else same)
    assert common[0] == -1


def test_maximal_repeats(spark):
    docs = [(1, "a b c d e f g h"), (2, "x a b c d e y a b c"), (3, "q")]
    out = substrings.maximal_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=3)
    assert sorted((r.doc, r.first, r.words) for r in out.collect()) == [(2, 1, 5), (2, 7, 3)]


def test_awkward_rows(spark, sf):
    docs = documents(spark)
    for f in (suffix_array.dedup, substrings.dedup):
        assert f(docs).count() == len(rows())
        assert f(docs.limit(0)).count() == 0
    out = suffix_array.stage(spark, docs, sf)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert texts.count(None) == 1 and "" in texts and all(len(t or "") < 200_000 for t in texts)

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from data import documents, rows, save
from test_quality import judged
from test_repeats import brute as repeated
from test_similar import brute as alike

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def topic(t):
    return "table" if " | " in t else "web" if "://" in t else "contact" if "@" in t else "prose"


def rake(docs):
    """Cells' odds, and each document's sum of words."""
    cell = defaultdict(float)
    for d in docs:
        cell[d["source"], d["lang"], topic(d["text"])] += len(d["text"].encode().split())
    keys, t = list(cell), np.array(list(cell.values()))
    w, budget = 0.7 * t, 0.7 * t.sum()
    goals = []
    for k, power in enumerate((0.7, 0.8, 0.9)):
        share = defaultdict(float)
        for key, x in cell.items():
            share[key[k]] += x
        share = {v: x**power for v, x in share.items()}
        goals.append({v: x / sum(share.values()) for v, x in share.items()})
    for _ in range(12):
        for k, goal in enumerate(goals):
            for v, g in goal.items():
                at = np.array([key[k] == v for key in keys])
                w[at] = np.minimum(t[at], w[at] * (budget * g) / w[at].sum())
    return dict(zip(keys, w / t))


def brute(docs):
    kept = judged(docs)
    docs = [d for d in docs if kept[d["doc_id"]]]
    least = alike([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if least[d["doc_id"]] == d["doc_id"]]
    for d, (s, gone) in zip(docs, repeated([(d["doc_id"], d["text"]) for d in docs], bytes, 100, True)):
        if any(gone):
            d["text"] = bytes(b for b, g in zip(s, gone) if not g).decode(errors="ignore")
    docs = [d for d in docs if d["text"]]
    odds = rake(docs)
    u = {d["doc_id"]: int(hashlib.md5(f"7:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52 for d in docs}
    docs = [d for d in docs if u[d["doc_id"]] < odds[d["source"], d["lang"], topic(d["text"])]]
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return {d["doc_id"]: np.array(lib.encode(d["text"], add_special_tokens=False).ids, "<u4").tobytes() for d in docs}


def test_equals_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    want = brute(docs)
    assert got == want and 20 < len(got) < len(docs)


def test_stages_keep_columns_on_awkward_rows(spark, sf, tmp_path):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    out = corpus_pipeline.run(spark, save(spark, tmp_path, docs))
    assert "ids" in out.columns and out.count() <= len(rows())


def test_marginals_are_met(spark):
    from fathomry.llm import mixing

    cells = [(s, l, float(10 * (i + 1) * (j + 2))) for i, s in enumerate("abc") for j, l in enumerate("xy")]
    df = spark.createDataFrame(cells, "source string, lang string, t double")
    out = mixing.rake(mixing.tempered(df, {"source": 0.9, "lang": 0.9}), ["source", "lang"], share=0.5, rounds=30).collect()
    total = sum(r.t for r in out)
    for dim in ("source", "lang"):
        for v in {r[dim] for r in out}:
            goal = next(r[f"goal_{dim}"] for r in out if r[dim] == v)
            assert math.isclose(sum(r.w for r in out if r[dim] == v), 0.5 * total * goal, rel_tol=1e-6)

import random

import numpy as np
import pytest
import xxhash
from data import documents, prose, rows

from fathomry.llm import simhash
from fathomry.llm.common import written
from fathomry.llm.components import components


def brute_fp(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, most=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints():
    texts = [r[1] or "" for r in rows()] + prose()
    assert simhash.fingerprints([t.encode() for t in texts], 3).tolist() == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("parts", [None, [simhash.Part(tuple(range(32)), 1), simhash.Part(tuple(range(32, 64)), 1)]])
def test_links_keep_all_components(spark, parts, monkeypatch):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base * 4]
    ids = list(range(len(fps)))
    r.shuffle(ids)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    if parts:
        monkeypatch.setattr(simhash, "plan", lambda *_: parts)
    marked = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in zip(ids, fps)], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(written(marked, "t")).collect()}
    assert [got[i] for i in ids] == brute_components(ids, fps)


def test_dense_group(spark, monkeypatch):
    """Everything within one ball: few links come out, and one component."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    fps = spark.range(400).selectExpr("id as fp")
    out = simhash.links(fps, [simhash.Part(tuple(range(60, 64)), 0), simhash.Part(tuple(range(16, 32)), 0), simhash.Part(tuple(range(32, 60)), 0), simhash.Part(tuple(range(16)), 0)])
    assert out.count() < 400 * 30
    assert components(out).select("b").distinct().count() == 1


def test_thresholds_add_up():
    cost, chosen = simhash.allocate([[0, 5, 9, 20], [0, 1, 2, 3], [0, 8, 9, 10]], 1)
    assert sum(chosen) == 1 and cost == min(a + b + c for i, a in enumerate([0, 5, 9, 20]) for j, b in enumerate([0, 1, 2, 3]) for k, c in enumerate([0, 8, 9, 10]) if i + j + k == 4)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a long, b long")
    got = {(r.a, r.b) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [brute_fp(d.text) for d in docs]
    want = dict(zip([d.doc_id for d in docs], zip([f"{f:016x}" for f in fps], brute_components([d.doc_id for d in docs], fps))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf).collect()}
    assert got == want


def test_awkward_rows(spark, sf):
    docs = documents(spark)
    marked = written(simhash.fingerprint(docs), "t")
    data = rows()
    out = simhash.near_duplicates(marked)
    assert out.count() == len(data)
    got = {(r.doc_id, r.text, r.component_id) for r in out.collect()}
    fps = [brute_fp(r[1]) for r in data]
    assert got == {(r[0], r[1], c) for r, c in zip(data, brute_components([r[0] for r in data], fps))}
    assert simhash.near_duplicates(written(marked.limit(0), "t")).count() == 0
    assert set(simhash.stage(spark, docs, sf).columns) == set(docs.columns)

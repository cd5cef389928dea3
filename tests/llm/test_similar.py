import random

import numpy as np
import pyarrow as pa
import pytest
from data import LONG, TEXTS, documents, prose, rows

from fathomry.llm import common, components, similar, simhash


def brute(docs, size=5):
    """Least id of each group whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in docs:
        w = t.encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def texts():
    """Prose, near copies on both sides of 0.8, a dense group of near copies, and a passage that many share."""
    r = random.Random(5)
    out = prose(80)
    for t in [t for t in out if len(t.split()) > 60][:25]:
        for edits in (1, 2, 4):
            w = t.split()
            for i in r.sample(range(len(w)), edits):
                w[i] = f"edit{r.random()}"
            out.append(" ".join(w))
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    for _ in range(60):
        w = list(base)
        for i in r.sample(range(150), 2):
            w[i] = f"e{r.random()}"
        out.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    return out + [passage + " " + " ".join(f"x{r.random()}" for _ in range(30)) for _ in range(40)]


@pytest.mark.parametrize("block", [16_384, 7])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    docs = list(enumerate(texts()))
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.similar(df).collect()} == brute(docs)


def test_stage_drops_all_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = brute([(r.doc_id, r.text or "") for r in docs.collect()])
    assert {r.doc_id for r in simhash.stage(spark, docs, sf).collect()} == {d for d, c in named.items() if d == c}


def test_stage_on_awkward_rows(spark, sf):
    docs = documents(spark)
    out = simhash.stage(spark, docs, sf)
    assert out.columns == docs.columns and simhash.stage(spark, docs.limit(0), sf).count() == 0
    texts = [r.text for r in out.collect()]
    # one of the empty sets, of the equal texts and of the repeated rows; the row without an id stays
    assert len(texts) == len(set(texts)) and texts.count(LONG) == 1 and texts.count(TEXTS[6]) == 1 and texts.count(TEXTS[5]) == 1
    assert sum(not (t or "").split() for t in texts) == 1 and rows()[-1][1] in texts


def test_groups_of_rows_with_one_id_or_none(spark, sf):
    base = " ".join(f"w{i}" for i in range(40))
    data = [(None, base), (None, base), (None, base + " x"), (None, "other words here"), (4, "lone text of its own"), (4, base.replace("w20", "q")), (4, "lone text of its own")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.stage(spark, docs, sf).collect())
    assert got == sorted([("4", "lone text of its own"), ("None", "other words here"), ("None", base), ("4", base.replace("w20", "q"))]) or got == sorted([("4", "lone text of its own"), ("None", "other words here"), ("None", base + " x"), ("4", base.replace("w20", "q"))])


@pytest.mark.parametrize("small", [128, 2])
def test_pairs_of_buckets(monkeypatch, small):
    monkeypatch.setattr(similar, "SMALL", small)
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(60)]
    sets = [np.unique(np.array([*r.sample(base, r.randint(44, 60)), *(r.getrandbits(64) for _ in range(r.randint(0, 8)))], np.uint64)) for _ in range(60)]
    run, root, v = np.sort(np.array([r.randrange(4) for _ in sets])), np.array([r.randrange(3) for _ in sets]), np.arange(60)
    monkeypatch.setattr(similar, "MAP", 64 if small == 2 else 512)  # sets on both sides of a bitmap's length
    here = similar.Rows.made(run, v, np.array(list(map(len, sets))), np.zeros(60, np.int64), root, list(map(similar.bitmap, sets)))
    want = {(i, j) for j in range(60) for i in range(j) if run[i] == run[j] and root[i] != root[j] and similar.alike(sets[i], sets[j])}
    got = [tuple(sorted(p)) for a, b in similar._all(here) for p in zip(a.tolist(), b.tolist())]
    assert want and want <= set(got) and len(got) == len(set(got)) < 60 * 59 / 4
    assert len(here.words) == (2 if small == 2 else 1)
    assert all(run[i] == run[j] and root[i] != root[j] for i, j in got)
    first = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in similar._likeliest(here)))}
    assert first <= set(got) and len(first) <= 60


def test_places_in_the_order_lose_no_pair():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(50)]
    sets = [sorted({*r.sample(base, r.randint(40, 50)), *(r.getrandbits(64) for _ in range(r.randint(0, 6)))}) for _ in range(80)]
    n, bits = np.array(list(map(len, sets))), [similar.bitmap(np.array(s, np.uint64)) for s in sets]
    alike, cut = 0, 0
    for i in range(80):
        for j in range(i):
            both = set(sets[i]) & set(sets[j])
            k = min(both)
            place = np.array([s.index(k) if k in s else 0 for s in sets])
            rows = similar.Rows.made(np.zeros(80, np.int64), np.arange(80), n, place, np.arange(80), bits)
            passed = rows.slack(np.array([i]), np.array([j]))[0] >= 0
            if 5 * len(both) >= 4 * (len(sets[i]) + len(sets[j]) - len(both)):
                alike += 1
                assert passed
            late = similar.Rows.made(np.zeros(80, np.int64), np.arange(80), n, n // 2, np.arange(80), bits)
            cut += late.slack(np.array([i]), np.array([j]))[0] < 0
    assert alike and cut == 80 * 79 // 2


def test_long_texts_come_in_small_batches(spark, sf, monkeypatch):
    seen, write = [], simhash.written

    def spied(df, name):
        seen.append(df.sparkSession.conf.get(common.BATCH_BYTES, None))
        return write(df, name)

    monkeypatch.setattr(similar, "written", spied)
    simhash.stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(20), sf)
    assert seen and set(seen) == {str(common.BATCH)} and spark.conf.get(common.BATCH_BYTES, None) is None

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with common.small_batches(spark):
        got = [r.n for r in spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 4000) as text").mapInArrow(sizes, "n long").collect()]
    assert len(got) > 1 and max(got) < 2 * common.BATCH


def test_few_links_are_one_file(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = components.components(links)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, 41)] and len(out.inputFiles()) == 1

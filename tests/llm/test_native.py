"""URL filters, shards, mixtures and fingerprints: the operators that stay in DataFrame functions."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from data import documents, rows, save
from pyspark.sql import functions as F

from fathomry.llm import merkle, mixing, sharding, urls

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.b.Example.ORG/en/1", "x://example.org/en/17?q=/es/", "http://example.org?/es/", "http://example.org#a",
    "http://org/x", "http://notexample.org/es/1", "http://badexample.com/de/", "http://com/de/9", "http://x.com/de", "http://x.net/fr/", "http://www.casino-win.example.net/a", "http://a://b/c", "http://exa mple.org/es/\n", "http://x.com/fr/1", "http://x.com/fr/1",
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    listed = any(w in host for w in urls.LISTED_WORDS)
    return host, path, rule, RULES[rule] if rule else "block" if listed else "allow"


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3]), (None, "http://x.org/")], "page_id long, url string").selectExpr("*", "'h' as html", "1 as rule", "2 as keys")
    out = urls.filter_urls(pages, list(urls.RULES), urls.hosts_with(pages, urls.LISTED_WORDS)).collect()
    got = sorted((str(r.page_id), str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in out)
    want = sorted((str(r.page_id), str(r.url), *[str(x) if k == 2 else x for k, x in enumerate(brute(r.url))]) for r in pages.collect())
    assert got == want
    assert urls.filter_urls(pages.limit(0), list(urls.RULES), urls.hosts_with(pages, ("x",))).count() == 0
    assert urls.filter_urls(pages, [], urls.hosts_with(pages.limit(0), ("x",))).where("verdict = 'block' or rule is not null").count() == 0


def test_urls_equal_sql(spark, sf):
    got = sorted((r.page_id, r.host, r.path, str(r.rule), r.listed_host, r.verdict) for r in urls.op1_url_filters(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    assert got == sorted((*r[:3], str(r[3]), *r[4:]) for r in con.execute(urls.ORACLE).fetchall())


@pytest.mark.parametrize("last,bits", [(4096, 1 << 26), (0, 1 << 26), (0, 1 << 12)])
def test_cascade_is_exact(spark, monkeypatch, last, bits):
    monkeypatch.setattr(urls, "LAST", last)
    monkeypatch.setattr(urls, "MOST_BITS", bits)
    from pyspark.sql import functions as F

    universe = urls.written(spark.range(3000).selectExpr("concat('k', id) as key", "id % 9 = 0 as listed"), "u")
    made = urls.listing(universe)
    assert len(made.slices) == (2 if bits == 1 << 12 else 1) and len(made.slices[0].levels) > 1
    assert universe.where(made.lists(F.col("key")) != F.col("listed")).count() == 0


def test_shards(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = sharding.op2_sharding(spark, sf).collect()
    slots = defaultdict(list)
    for r in out:
        b = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "key") and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(out) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < 40
    assert sorted(map(tuple, sharding.op2_sharding(spark, sf).collect())) == sorted(map(tuple, out))


def test_shards_follow_the_highest_hash(spark, sf):
    """shard and grown_shard by a plain highest-hash choice; each shard's buckets and what each holds by the record's hash."""

    def best(key, shards):
        def score(s):
            h = xxhash.xxh64_intdigest(struct.pack("<i", 11), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", s), h)
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
            return h - (1 << 64) if h >= 1 << 63 else h

        return max(range(shards), key=lambda s: (score(s), s))

    out = sharding.op2_sharding(spark, sf).collect()
    assert all((r.shard, r.grown_shard) == (best(r.doc_id, 40), best(r.doc_id, 41)) for r in out)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.length("text").cast("long"))
    dealt, n = sharding.scatter(docs, "doc_id", "size", 3, 11, 20_000)
    rows_ = dealt.withColumn("h", F.xxhash64(F.lit(12), *docs.columns)).collect()
    sizes = [sum(r["size"] for r in rows_ if r.shard == s) for s in range(3)]
    counts = [max(1, -(-x // 20_000)) for x in sizes]
    assert n == sum(counts) and all(r.bucket == sum(counts[: r.shard]) + r.h % counts[r.shard] for r in rows_)


def test_shuffle_moves_whole_records(spark, tmp_path):
    docs = documents(spark).selectExpr("*", "coalesce(length(text), 0) + 16L as size")
    out = sharding.external_shuffle(docs, "doc_id", "size", shards=3, bucket_bytes=4000)
    got = out.collect()
    assert len(got) == len(rows()) and sorted(str(r.text) for r in got) == sorted(str(r[1]) for r in rows())
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    sharding.write_shards(docs, str(tmp_path / "s"), "doc_id", "size", shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows())
    assert sharding.external_shuffle(docs.limit(0), "doc_id", "size", shards=3).count() == 0


def test_records_are_shuffled_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.octet_length("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt, _ = sharding.scatter(docs, "doc_id", "size", 4, 11, 50_000)
        sharding.write_shards(docs, f"{tmp_path}/shards", "doc_id", "size", shards=4, bucket_bytes=50_000)
        for df in (dealt, sharding.read_shards(docs, f"{tmp_path}/shards")):
            assert "SortMergeJoin" not in df._jdf.queryExecution().toString()
            assert df.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_leaves_no_order(spark):
    rows_ = spark.range(2000).selectExpr("id", "16L as size")
    ids = [r.id for r in sharding.external_shuffle(rows_, "id", "size", shards=1).orderBy("slot").collect()]
    assert sorted(ids) == list(range(2000)) and sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:])) < 20


def test_shards_hold_the_texts(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "shared_dir", lambda _: str(tmp_path))
    sharding.op2_sharding(spark, sf)
    (path,) = tmp_path.glob("shards-*")
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(spark.read.parquet(str(path)).select("doc_id", "text").collect()) == sorted(want)


def test_a_hot_key_is_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 50)
    rows_ = spark.range(3000).selectExpr("if(id < 2000, null, id) as k", "if(id < 1000, -1, id) as v", "100L as size")  # 1,000 of them equal
    dealt, n = sharding.scatter(rows_, "k", "size", 4, 11, 10_000)
    buckets = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert sum(buckets) == 3000 and max(buckets) < 200 and n >= 30
    out = sharding.external_shuffle(rows_, "k", "size", shards=4, bucket_bytes=10_000).collect()
    assert sorted(r.v for r in out) == sorted([-1] * 1000 + list(range(1000, 3000)))
    for shard in range(4):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_mixture_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = con.execute(mixing.ORACLE)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in mixing.op6_mixing(spark, sf).collect()) == want


def test_mixture_of_awkward_rows(spark):
    docs = documents(spark).withColumn("topic", mixing.topic()).withColumn("tokens", mixing.tokens())
    out = mixing.mix(docs, mixing.DIMS, mixing.POWERS).collect()
    assert len(out) == len(rows()) and all(0 <= r.probability <= 1 for r in out)
    assert mixing.mix(docs.limit(0), mixing.DIMS, mixing.POWERS).count() == 0


def order(docs):
    """Distinct (id, text) in the operator's order: null ids first, equal ids by a hash of the text."""
    return sorted({(d is not None, d or 0, t or "") for d, t in docs})


def test_fingerprints(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in merkle.op9_fingerprints(spark, sf).collect()}
    prints = defaultdict(set)
    for i, (d, t) in enumerate(docs):
        nxt, m = docs[(i + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - m] + nxt[:m]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        prints[t].add(got[d].fingerprint)
        if len(t) > 400:
            assert 0.25 < got[d].near_edited and got[d].near_next < got[d].near_edited
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)


def test_fingerprints_of_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    out = merkle.op9_fingerprints(spark, save(spark, tmp_path, docs)).collect()
    assert len(out) == len(rows())
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = merkle.op9_fingerprints(spark, save(spark, tmp_path, one)).first()
    assert (r.edited_sha256, r.near_next) == (hashlib.sha256(b"aba").hexdigest(), 1.0)
    assert merkle.op9_fingerprints(spark, save(spark, tmp_path, one.limit(0))).count() == 0


def plain_tree(text):
    """Root, paragraphs and leaves of a text, from its lines."""

    def folded(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
            h = seed
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    def signed(h):
        return h - (1 << 64) if h >= 1 << 63 else h

    lines = [[signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.findall(merkle.LEAF, line)] for line in text.split("\n")]
    paragraphs = [folded(x) for x in lines]
    sections = [folded(paragraphs[i : i + 8]) for i in range(0, len(paragraphs), 8)]
    root = hashlib.md5("".join(f"{x & (1 << 64) - 1:X}" for x in sections).encode()).hexdigest()
    return root, paragraphs, [h & 0xFFFFFFFF for x in lines for h in x]


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    return max(2 * sum(x == y for x, y in zip(a, b)) / (len(a) + len(b)), 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))))


def test_fingerprints_equal_a_plain_tree(spark, sf, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    texts += ["".join(chr(0x4E00 + (i * k) % 5000) for k in range(400)) for i in (7, 11, 13)] + ["a" * 400, "", "é\n\n" * 30, "x y\n" * 9]
    path = save(spark, tmp_path, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in merkle.op9_fingerprints(spark, path).collect()}
    for i, t in enumerate(texts):
        nxt, m = texts[(i + 1) % len(texts)], len(t) // 2
        own, new, other = plain_tree(t), plain_tree(t[: len(t) - m] + nxt[:m]), plain_tree(nxt)
        told = lambda x: f"{x[0]}-" + "".join(f"{h:08x}" for h in x[2])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (told(own), told(new))
        assert np.isclose(got[i].near_edited, plain_likeness(own[2], new[2])) and np.isclose(got[i].near_next, plain_likeness(own[2], other[2]))
        assert got[i].n_edited_paragraphs == sum(k >= len(new[1]) or p != new[1][k] for k, p in enumerate(own[1]))
    for i in range(len(texts) - 7, len(texts) - 3):  # texts without blanks, half of each kept
        assert got[i].near_edited >= 0.3


def test_edits_are_located(spark):
    a = "\n".join(f"line number {i} of the text" for i in range(30))
    b = a.replace("number 17", "changed 17")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    trees = merkle.trees(merkle.trees(df, "a", "x"), "b", "y")
    r = trees.select(merkle.edits("x", "y").alias("e"), (merkle.F.col("x_root") == merkle.F.col("y_root")).alias("same")).first()
    assert r.e == [17] and not r.same

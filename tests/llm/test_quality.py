import re
from collections import Counter, defaultdict

import duckdb
from data import documents, prose, rows

from fathomry.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def judged(docs):
    """kept by doc_id, for dicts with doc_id, text and source."""
    base, rule, hosts = {}, {}, defaultdict(list)
    for d in docs:
        n, letters, symbols, lines, again = brute(d["text"] or "")
        base[d["doc_id"]] = n < 50 or 2 * again > n
        rule[d["doc_id"]] = 10 * symbols > n or 10 * lines > n or letters < 2.5 * n or letters > 12 * n
        if d["source"] is not None:
            hosts[d["source"]].append(base[d["doc_id"]] or rule[d["doc_id"]])
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    mean, size = quality.prior(len(hosts), n, f, sum(sum(x) ** 2 / len(x) for x in hosts.values()))
    rate = {h: (sum(x) + mean * size) / (len(x) + size) for h, x in hosts.items()}
    top = min(0.8, max(2 * mean, mean + 3 * (mean * (1 - mean) / (size + 1)) ** 0.5)) if hosts else 0
    return {d["doc_id"]: not base[d["doc_id"]] and not rate.get(d["source"], 0) > top and (not rule[d["doc_id"]] or d["source"] in rate and rate[d["source"]] < mean / 2) for d in docs}


def test_counts_equal_brute_force():
    for t in [r[1] or "" for r in rows()] + prose() + ["a b c a b c a", "a a a a", "l\nl\nl #"]:
        assert quality.counts(t.encode()) == brute(t)


def test_prior():
    assert quality.prior(0, None, None, None) == (0.0, 1.0)
    mean, size = quality.prior(2, 200, 100, 100 * 0.9**2 + 100 * 0.1**2)
    assert mean == 0.5 and size == 1.0
    assert quality.prior(2, 200, 20, 2 * 100 * 0.1**2)[1] == 1000.0


def test_a_bad_host_takes_its_documents(spark):
    good = [(i, "w%d " * 60 % tuple(range(60)), "good") for i in range(30)]
    bad = [(100 + i, "short", "bad") for i in range(30)] + [(200, "w%d " * 60 % tuple(range(60)), "bad")]
    m = quality.measure(spark.createDataFrame(good + bad, "doc_id long, text string, source string"))
    kept = {r.doc_id: r.kept for r in quality.judge(m, quality.host_rates(m)).collect()}
    assert all(kept[i] for i in range(30)) and not kept[200] and not kept[100]


def test_verdicts_act_on_hosts_and_on_documents(spark):
    fine = "w%d " * 60 % tuple(range(60))
    docs = []
    for h in range(20):
        share = 0.7 if h == 3 else 0.0 if h == 5 else 0.1
        docs += [(1000 * h + i, "short" if i < 100 * share else fine, f"host{h}") for i in range(100)]
    docs += [(1, fine + "# " * 20, None), (2, fine + "# " * 20, "host9"), (3, fine + "# " * 20, "host5"), (4, fine, None), (5, "line\n" * 40 + fine, "host9")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    m = quality.measure(frame)
    rates = {r.host: r for r in quality.host_rates(m).collect()}
    assert {h for h, r in rates.items() if r.host_rejected} == {"host3"} and {h for h, r in rates.items() if r.host_trusted} == {"host5"}
    kept = {r.doc_id: r.kept for r in quality.judge(m, quality.host_rates(m)).collect()}
    assert kept == judged([dict(zip(("doc_id", "text", "source"), d)) for d in docs])
    assert not kept[3099] and kept[9099] and not kept[1] and not kept[2] and kept[3] and kept[4] and not kept[5]


def test_awkward_rows(spark, sf):
    docs = documents(spark)
    out = quality.stage(spark, docs, sf)
    assert out.columns == docs.columns
    m = quality.measure(docs)
    assert m.where("base_failed").count() == sum(1 for r in rows() if brute(r[1] or "")[0] < 50 or 2 * brute(r[1] or "")[4] > brute(r[1] or "")[0])
    assert quality.stage(spark, docs.limit(0), sf).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    found = con.execute(quality.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[c] for c in names) for r in quality.op7_quality_rules(spark, sf).collect()) == sorted(found.fetchall())

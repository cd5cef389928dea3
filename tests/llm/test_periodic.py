import hashlib
import random
import re
import zlib

import pytest
from data import documents, prose, rows, save

from fathomry.llm import periodic
from fathomry.llm.queries import QUERIES


def brute(words):
    """Runs by trying each period from each place."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def modified(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = modified(doc_id, text)
    found = brute(words)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (told, " ".join(keep)))


def found_in(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    texts = [" ".join(words).encode()]
    got, bounds = periodic.words_of(texts)
    assert len(set(got.tolist())) == len(ids) and bounds.tolist() == [0, len(words)]
    return sorted({r for _, a, b in periodic.stretches(got, bounds) for r in periodic.runs_in(got.tolist(), a, b)}, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(300):
        words = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("abcd") for _ in range(r.randint(1, 9))]
            at = r.randint(0, len(words))
            words[at:at] = (unit * 9)[: r.randint(len(unit), 9 * len(unit))]
        assert found_in(words) == sorted(brute(words), key=lambda x: (x[0], x[2])), words


def test_the_automaton_alone_finds_all_runs():
    r = random.Random(9)
    for _ in range(300):
        words = [r.randint(0, 1) for _ in range(r.randint(1, 60))]
        assert periodic.runs_in(words, 0, len(words)) == sorted(brute(words), key=lambda x: (x[0], x[2]))


def test_nested_and_long_runs():
    inner = (["a"] * 7 + ["b"]) * 5
    assert found_in(inner) == sorted(brute(inner), key=lambda x: (x[0], x[2]))
    assert found_in(["w"] * 50_000) == [(0, 50_000, 1)]
    big = [f"w{i}" for i in range(5000)] * 4 + ["end"]
    assert found_in(big) == [(0, 20_000, 5000)]


def test_awkward_rows(spark):
    out = {r.doc_id: r for r in periodic.find_runs(documents(spark).withColumnRenamed("n_words", "START")).collect()}
    for r in rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        if len(words) < 1000:
            assert out[r[0]].n_runs == len(brute(words))
    assert (out[12].start, out[12].length, out[12].period, out[12].collapsed) == (0, 30_000, 1, "lorem")
    assert out[0].collapsed == "" and out[0].start is None
    assert periodic.find_runs(documents(spark).limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    texts = [r[:2] for r in rows() if len(r[1] or "") < 20_000] + list(enumerate(prose(200), 100))
    path = save(spark, tmp_path, spark.createDataFrame(texts, "doc_id long, text string"))
    out = QUERIES["op13_periodic_runs"](spark, path)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected(*t) for t in texts), key=repr)
    assert any(r.n_runs for r in out.collect())

"""Subsets without replacement against a plain ranking by hash."""

import hashlib

import pytest

from fathomry.operators import manifest


def plain(rows, subsets, m):
    out = set()
    for s in range(subsets):
        for side in {r[1] for r in rows}:
            mine = sorted((hashlib.md5(f"{s}:{i}".encode()).hexdigest(), i) for i, x in rows if x == side)
            out |= {(s, side, i) for _, i in mine[:m]}
    return out


@pytest.mark.parametrize("slack", [8.0, 0.0, -1.0])
def test_subsets_equal_a_ranking(spark, slack):
    rows = [(i, None if i % 10 == 0 else "a" if i % 3 else "b") for i in range(3000)] + [(5000 + i, "few") for i in range(4)]
    df = spark.createDataFrame(rows, "id long, side string")
    got = manifest.random_subsets(df, "id", 6, 20, ("side",), slack=slack)
    found = [(r.subset, r.side, r.id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, 6, 20) and set(got.columns) == {"id", "side", "subset"}
    whole = [(i, 0) for i, _ in rows]
    assert {(r.subset, 0, r.id) for r in manifest.random_subsets(df, "id", 4, 7, slack=slack).collect()} == plain(whole, 4, 7)


def test_few_rows_are_shuffled(spark):
    df = spark.range(200_000).selectExpr("id", "id % 2 AS side")
    got = manifest.random_subsets(df, "id", 10, 100, ("side",))
    held = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert got.count() == 10 * 2 * 100 and len(held) >= 1
    assert manifest.random_subsets(df.limit(0), "id", 3, 5, ("side",)).count() == 0

"""How many rows of a key meet in a task."""

import numpy as np
from pyspark.sql import functions as F

from fathomry.operators import tiles


def test_blocks_of_a_key_are_bounded_in_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i % 2, i, [float(v) for v in x]) for i, x in enumerate(r.standard_normal((200, 4)))], "k int, id long, x array<double>")
    want = sorted(tiles.radius(points, 3, keys=("k",)).collect())
    monkeypatch.setattr(tiles, "BYTES", 256 * 8 * 4)
    monkeypatch.setattr(tiles, "ROWS", 16, raising=False)
    dealt, _ = tiles._dealt(points, points, ["k"], None, None)
    assert dealt.agg(F.max("__n")).first()[0] == 7
    assert sorted(tiles.radius(points, 3, keys=("k",)).collect()) == want


def test_pairs_of_equal_distance_lie_together(spark, tmp_path):
    from fathomry.plans.queries import QUERIES

    n = 1200
    x = np.random.default_rng(3).standard_normal((2 * n, 4)) * 0.02
    spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    QUERIES["j07_distances"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * n * n  # a double alone is 8 bytes
    rows = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(["id", "neighbour"])
    assert rows[["id", "neighbour"]].to_numpy().tolist() == [[i, j] for i in range(1, 2 * n, 2) for j in range(0, 2 * n, 2)]
    assert np.abs(rows["d"].to_numpy().reshape(n, n) - np.linalg.norm(x[1::2, None] - x[None, ::2], axis=2)).max() < 6e-7


def test_pairs_keep_their_values_in_any_order():
    x, y = (tiles.Side(np.arange(n) * 3, np.random.default_rng(n).standard_normal((n, 2)), {}, "dot") for n in (700, 800))
    made = tiles._Pairs(x, "dot", lambda s: tiles.half_up(s, 2))
    made.add(*tiles.products(x.part(1, 700), y, "dot"), x.part(1, 700), 1, y)
    rows, (ids, near, s) = made.told()
    assert (ids == x.ids[rows]).all() and len(set(zip(ids.tolist(), near.tolist()))) == 699 * 800
    assert np.abs(s - np.einsum("ij,ij->i", x.x[rows], y.x[near // 3])).max() < 0.00501
    assert (s[1:] != s[:-1]).sum() + 1 == len(np.unique(s.view(np.int64)))


def test_rounding_inside_tasks():
    got = tiles.half_up(np.array([-1e-9, -0.0, 0.0, 1e-9, -0.25, 0.35, -0.35, 1e20, np.inf, -np.inf, np.nan]), 1)
    assert [repr(float(v)) for v in got] == ["-0.0", "-0.0", "0.0", "0.0", "-0.3", "0.4", "-0.4", "1e+20", "inf", "-inf", "nan"]

"""Parallel prefixes against plain loops."""

import numpy as np
import pytest

from fathomry.operators import scans, telemetry


def series(seed=1):
    r = np.random.default_rng(seed)
    rows = [("long", i, float(v)) for i, v in enumerate(r.normal(12, 5, 1000))]
    rows += [("tied", 7, float(v)) for v in r.normal(12, 5, 300)]
    rows += [(None, i, float(v)) for i, v in enumerate(r.normal(12, 5, 90))] + [("short", 3, 5.0), ("gap", 1, None), ("gap", 2, 9.0), ("gap", None, 1.0)]
    order = r.permutation(len(rows))
    return [rows[i] for i in order]


def plain(rows):
    out = {}
    for k, o, v in sorted((r for r in rows if None not in r[1:]), key=lambda r: r[1:]):
        i, x, p = out.get(k, (0, 0.0, 0.0))
        d = min(0.9, (1 + i) / (10 + i)) if i else 0.0
        out[k] = (i + 1, v + (x - v) * d, min(1.0, max(0.0, p + 0.05 * np.sign(v - 12))))
    return out


@pytest.mark.parametrize("size", [10, 64, 1 << 18])
def test_chunked_folds_equal_loops(spark, size):
    rows = series()
    df = spark.createDataFrame(rows, "k string, step long, value double").repartition(6)
    want = plain(rows)
    ema = {r.k: (r.n, r.ema) for r in telemetry.ema(df, ["k"], 0.9, size=size).collect()}
    assert ema.keys() == want.keys() and all(ema[k][0] == want[k][0] and np.isclose(ema[k][1], want[k][1]) for k in want)
    p = {r.k: r.p for r in telemetry.controller(df, ["k"], target=12, gain=0.05, size=size).collect()}
    assert p.keys() == want.keys() and all(np.isclose(p[k], want[k][2]) for k in want)


def test_a_long_series_lies_in_many_chunks(spark):
    df = spark.range(5000).selectExpr("'a' AS k", "id AS step", "double(id) AS value").union(spark.range(7).selectExpr("'b'", "id", "double(id)"))
    made = {(r.k, r.chunk): r for r in scans.chunks(df, ["k"], "step", "value", size=100).collect()}
    mine = [made[k] for k in sorted(made) if k[0] == "a"]
    assert len(mine) >= 40 and max(len(r["values"]) for r in mine) < 250 and [r["values"][0] for r in mine] == [r["first"] for r in mine]
    assert len([k for k in made if k[0] == "b"]) == 1
    assert scans.chunks(df.limit(0), ["k"], "step", "value").count() == 0


def test_prefixes_by_doubling():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 64, 101):
        a, b, c = r.uniform(0, 1, n), r.normal(size=n), r.choice([-0.3, 0.3, 0.0], n)
        x, p, xs, ps = 0.7, 0.2, [], []
        for i in range(n):
            x, p = a[i] * x + b[i], min(1, max(0, p + c[i]))
            xs.append(x)
            ps.append(p)
        fa, fb = scans.affine_prefixes(a, b)
        s, lo, hi = scans.clip_prefixes(c, 0.0, 1.0)
        assert np.allclose(fa * 0.7 + fb, xs) and np.allclose(np.clip(0.2 + s, lo, hi), ps)


@pytest.mark.parametrize("size", [10, 64])
def test_windows_over_long_series(spark, size):
    rows = [r for r in series(4) if r[0] != "tied" and None not in r]  # the order of ties is open
    df = spark.createDataFrame(rows + [(None, 500, None), (None, 501, 7.0)], "k string, step long, value double").repartition(6)
    wide = 1 << 18
    for f, name in ((telemetry.running_best, "size"), (telemetry.smoothed, "chunk"), (telemetry.cumulative_mean, "size")):
        whole, cut = f(df, ["k"], **{name: wide}), f(df, ["k"], **{name: size})
        assert whole.columns == cut.columns
        got, want = (sorted((tuple(r) for r in x.collect()), key=repr) for x in (cut, whole))
        assert len(got) == len(want) == len(rows) + 2
        for a, b in zip(got, want):
            assert a[:3] == b[:3] and all(x == y if x is None or y is None or isinstance(x, bool) else np.isclose(x, y) for x, y in zip(a[3:], b[3:]))

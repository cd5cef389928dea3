"""Metrics against short NumPy versions, hand cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.functions import scalars as S
from fathomry.functions import vectors as V
from fathomry.operators import feature_metrics as M
from fathomry.operators import manifest, masks, moments, ranks, runs, telemetry, tiles


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(1).standard_normal((120, 6)) + np.arange(6) * 0.1


def frame(spark, x, side=None, label=None):
    rows = [(i, side[i] if side else "real", int(label[i]) if label is not None else 0, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, side string, label int, x array<double>")


def test_moments_do_not_depend_on_partitions(spark, cloud):
    for n in (1, 4, 13):
        (count, mean, cov), = moments.collected(moments.merged(moments.partial(frame(spark, cloud).repartition(n)))).values()
        assert count == 120 and np.allclose(mean, cloud.mean(0)) and np.allclose(cov, np.cov(cloud.T, bias=True))


def test_frechet(spark, cloud):
    other = cloud[::-1] * 1.3 + 0.2
    both = frame(spark, np.vstack([cloud, other]), ["gen"] * 120 + ["real"] * 120)
    got = moments.frechet_distance(both).first()[0]
    ca, cb = np.cov(cloud.T, bias=True), np.cov(other.T, bias=True)
    roots = np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
    assert np.isclose(got, ((cloud.mean(0) - other.mean(0)) ** 2).sum() + np.trace(ca + cb) - 2 * roots)
    same = frame(spark, np.vstack([cloud, cloud]), ["gen"] * 120 + ["real"] * 120)
    assert abs(moments.frechet_distance(same).first()[0]) < 1e-6


def test_descriptors(spark, cloud):
    r = moments.descriptors(frame(spark, cloud)).first()
    c = np.corrcoef(cloud.T)
    s = np.linalg.svd(cloud, compute_uv=False)
    assert np.isclose(r.mean_corr, np.abs(c[~np.eye(6, dtype=bool)]).mean()) and r["rank"] == 6
    assert np.isclose(r.mean_std, cloud.std(0, ddof=1).mean()) and np.isclose(r.anisotropy, s[0] ** 2 / (s**2).sum())


@pytest.mark.parametrize("block", [7, 4096])
def test_tiles_equal_numpy(spark, cloud, block):
    d = np.linalg.norm(cloud[:, None] - cloud[None], axis=2)
    df = frame(spark, cloud)
    r = {x.id: x.r for x in tiles.radius(df, 3, block=block).collect()}
    assert np.allclose([r[i] for i in range(120)], np.sort(d, axis=1)[:, 3])
    found = tiles.nearest(df.where("id < 20"), df, 5, metric="cos", block=block).collect()
    u = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    best = np.argsort(-(u[:20] @ u.T), axis=1, kind="stable")[:, :5]
    assert {(x.id, x.place): x.neighbour for x in found} == {(i, k + 1): int(best[i, k]) for i in range(20) for k in range(5)}


def test_precision_of_a_set_with_itself(spark, cloud):
    both = frame(spark, np.vstack([cloud, cloud]), ["gen"] * 120 + ["real"] * 120)
    assert tuple(M.precision_recall(both).first()) == (1.0, 1.0)


def test_point_on_the_radius_counts(spark):
    x = np.array([[0.0], [1.0], [2.0], [3.0], [6.0]])
    df = frame(spark, np.vstack([x[:4], x[4:]]), ["real"] * 4 + ["gen"])
    assert M.precision_recall(df, k=3).first().precision == 1.0


def test_class_without_one_side_scores_zero(spark, cloud):
    df = frame(spark, cloud, ["gen" if i % 2 else "real" for i in range(120)], [i // 60 for i in range(120)]).where("not (label = 1 and side = 'gen')")
    got = {r.label: (r.precision, r.recall) for r in M.class_precision_recall(df).collect()}
    assert got[1] == (0.0, 0.0) and got[0] != (0.0, 0.0)


def test_kid_is_symmetric(spark, cloud):
    x = np.vstack([cloud, cloud * 1.5])
    a = M.kernel_distance(frame(spark, x, ["gen"] * 120 + ["real"] * 120), subsets=2, m=30).first()[0]
    b = M.kernel_distance(frame(spark, x, ["real"] * 120 + ["gen"] * 120), subsets=2, m=30).first()[0]
    assert np.isclose(a, b)


def test_moments_edges(spark):
    rows = [("none", None), ("none", float("nan")), ("one", 2.0), ("same", 3.0), ("same", 3.0)]
    got = {r.name: (r.num, r["mean"], r["std"]) for r in telemetry.moments(spark.createDataFrame(rows, "name string, value double"), ["name"]).collect()}
    assert got == {"none": (0, None, None), "one": (1, 2.0, 0.0), "same": (2, 3.0, 0.0)}


def test_lower_median(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3, 4)], "name string, step int, value double")
    assert telemetry.smoothed(df, ["name"]).orderBy("step").collect()[-1]["median"] == 2.0


def test_trimmed_mean(spark):
    v = np.random.default_rng(2).permutation(1000) // 3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, d double")
    lo, hi = np.percentile(v, 1, method="lower"), np.percentile(v, 99, method="higher")
    assert np.isclose(M.trimmed_mean(df, "d", "id").first()[0], v[(v >= lo) & (v <= hi)].mean())


def test_ranks(spark):
    df = spark.createDataFrame([(int(i),) for i in np.random.default_rng(3).permutation(500) ** 2], "id long")
    got = [r["rank"] for r in ranks.order_rank(df, "id").orderBy("id").collect()]
    assert got == list(range(500))
    assert ranks.order_rank(df.limit(0), "id").count() == 0


def test_best_rows_take_the_first_of_equals(spark):
    rows = [(1, "a", 0.5), (2, "a", 0.9), (3, "a", 0.9), (4, "b", None), (5, None, 1.0)]
    got = runs.best_rows(spark.createDataFrame(rows, "id int, k string, m double"), ["k"], "m", "id").collect()
    assert [r.id for r in got] == [2]


def test_last_rule_wins(spark):
    df = spark.createDataFrame([("ab",)], "n string")
    rule = runs.last_rule([(F.col("n").contains("a"), "A"), (F.col("n").contains("b"), "B")])
    assert df.select(rule).first()[0] == "B"


def test_greedy_masks(spark):
    cells = [(0, m, y, x, s) for m, s, w in ((0, 0.9, 4), (1, 0.8, 4), (2, 0.7, 2)) for y in range(4) for x in range(w)]
    df = spark.createDataFrame(cells, "image long, mask int, y int, x int, score double")
    assert [r.mask for r in masks.deduplicated(df).collect()] == [0, 2]


def test_spectrum(spark):
    x = np.random.default_rng(4).standard_normal((10, 16))
    got = masks.power_spectrum(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), 4, mean=0.1, std=2.0)
    row = np.kaiser(4, 8) / np.linalg.norm(np.kaiser(4, 8))
    w = row[:, None] * row[None, :]
    assert np.isclose((w**2).sum(), 1) and all(np.isclose((masks.spectrum_window(n, 8.0) ** 2).sum(), 1) for n in (4, 8, 64))
    want = (np.abs(np.fft.fft2((x.reshape(-1, 4, 4) - 0.1) / 2 * w)) ** 2).mean(0)
    assert np.allclose([r.power for r in got.orderBy("ky", "kx").collect()], want.ravel())


def test_vectors_by_hand(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    row = df.select(V.unit("a"), V.cosine("a", "b"), V.distance("a", "b"), V.unit(F.array(F.lit(0.0))), V.slerp("a", "a", F.lit(0.5)), V.standardise("a", "b", F.array(F.lit(0.0), F.lit(2.0)))).first()
    assert row[0] == [0.6, 0.8] and row[1] == 0.8 and np.isclose(row[2], 13**0.5) and row[3] == [0.0] and np.allclose(row[4], [0.6, 0.8]) and row[5] == [0.0, 1.0]


def test_strings(spark):
    s = lambda *c: spark.range(1).select(*c).first()
    assert tuple(s(S.duration(F.lit(59)), S.duration(F.lit(3661)), S.duration(F.lit(90061)))) == ("59s", "1h 01m 01s", "1d 01h 01m")
    assert tuple(s(S.stem(F.lit("a\\b.c/d.e.PNG")), S.extension(F.lit("a.b/x")), S.zero_padded(F.lit(123456), 5))) == ("d.e", "", "123456")
    assert S.args_key({"b": 1, "a": [2]}) == S.args_key({"a": [2], "b": 1}) != S.args_key({"a": [2]})


def test_registry():
    assert M.is_valid_metric("fid50k_full") and not M.is_valid_metric("fid")
    with pytest.raises(ValueError):
        M.metric("fid")(lambda f: f)


def test_flatten(spark):
    df = spark.sql("select 1 a, named_struct('bb', 2) b, named_struct('cc', named_struct('ccc', 3), 'cc1', 33) c")
    assert runs.flattened(df).columns == ["a", "b_bb", "c_cc_ccc", "c_cc1"]


def test_synthetic_vectors(spark):
    from fathomry.sources.readers import synthetic_representations

    x = np.array([r.x for r in synthetic_representations(spark, 400, 16).collect()])
    again = {r.id: r.x for r in synthetic_representations(spark.newSession(), 400, 16).repartition(7).collect()}
    assert x.shape == (400, 16) and abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    assert all(np.array_equal(again[i], x[i]) for i in (0, 399))


def test_info_nce_of_many_blocks(spark):
    import numpy as np

    from fathomry.operators import feature_metrics

    r = np.random.default_rng(4)
    q, pos, neg = r.normal(size=(30, 4)), r.normal(size=(30, 4)), r.normal(size=(70_000, 4))
    queries = spark.createDataFrame([(i, q[i].tolist(), pos[i].tolist()) for i in range(30)], "id long, q array<double>, positive array<double>")
    bank = spark.createDataFrame([(i, x) for i, x in enumerate(neg.tolist())], "id long, x array<double>")
    u, p, n = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, pos, neg))
    at = (u * p).sum(axis=1) / 0.2
    want = np.log(np.exp(at) + np.exp(u @ n.T / 0.2).sum(axis=1)) - at
    got = {x.id: x.loss for x in feature_metrics.info_nce(queries, bank, 0.2, block=20_000).collect()}
    assert np.allclose([got[i] for i in range(30)], want)


def test_descriptors_of_a_constant_column(spark):
    x = np.random.default_rng(1).standard_normal((50, 3))
    x[:, 1] = 2.0
    row = moments.descriptors(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")).first()
    assert row.mean_corr == -1 and np.isclose(row.nansafe_corr, 2 * abs(np.corrcoef(x[:, 0], x[:, 2])[0, 1]) / 6)


def test_small_grids_are_refused(spark):
    ids = spark.range(5).withColumnRenamed("id", "k")
    found = manifest.multiblock_masks(ids, "k").collect()
    assert all(len(c) > 10 for r in found for c in (*r.contexts, *r.targets))
    with pytest.raises(ValueError, match="larger grid"):
        manifest.multiblock_masks(ids, "k", grid=(6, 6))


def test_keys_of_arguments(spark):
    row = spark.createDataFrame([("é b", 3, None)], "a string, n long, z string").select(S.args_key_of("z", "n", "a")).first()
    assert row[0] == S.args_key({"n": 3, "z": None, "a": "é b"})


def test_row_transforms(spark):
    out = M.transformed(spark.range(6), lambda r: {"id": r["id"] * 2, "s": "x"} if r["id"] % 2 else None, "id long, s string")
    assert sorted((r.id, r.s) for r in out.collect()) == [(2, "x"), (6, "x"), (10, "x")]


@pytest.mark.parametrize("block", [3, 50, None])
def test_tiles_by_key_equal_numpy(spark, block):
    r = np.random.default_rng(7)
    x = r.integers(-3, 4, (400, 5)).astype(float)  # with ties
    label = [None if c > 97 else f"c{min(c, 40)}" for c in r.integers(0, 100, 400)]  # one large class, small ones, and null
    side = ["real" if i % 3 else "gen" for i in range(400)]
    rows = [(i, side[i], label[i], v.tolist()) for i, v in enumerate(x)] + [(400, "gen", "c40", None)]
    df = spark.createDataFrame(rows, "id long, side string, label string, x array<double>").repartition(5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = np.array([[a == b for b in label] for a in label])
    found = {(t.id, t.place): t.neighbour for t in tiles.nearest(df, df, 4, keys=("label",), block=block).collect()}
    for i in range(400):
        near = sorted((j for j in range(400) if same[i, j]), key=lambda j: (round(d[i, j], 9), j))[:4]
        assert [found.get((i, k + 1)) for k in range(4)] == near + [None] * (4 - len(near))
    pairs = {(t.id, t.neighbour): t.score for t in tiles.all_pairs(df.where("side = 'gen'"), df.where("side = 'real'"), keys=("label",), block=block).collect()}
    want = {(i, j): -(d[i, j] ** 2) for i in range(400) for j in range(400) if same[i, j] and side[i] == "gen" and side[j] == "real"}
    assert pairs.keys() == want.keys() and np.allclose([pairs[k] for k in want], list(want.values()))
    sums = {(t.label, t.p, t.q): (t.s, t.n) for t in tiles.pair_sums(df, df, lambda s: (s + 1) ** 3, "side", keys=("label",), block=block).collect()}
    k = (x @ x.T + 1) ** 3
    for c in set(label):
        for p in ("real", "gen"):
            for q in ("real", "gen"):
                rows_, cols = ([i for i in range(400) if label[i] == c and side[i] == s] for s in (p, q))
                if rows_ and cols:
                    s, n = sums[c, p, q]
                    assert n == len(rows_) * len(cols) and np.isclose(s, k[np.ix_(rows_, cols)].sum())
    balls = df.where("side = 'real'").withColumn("r", F.lit(2.0))
    hit = {t.id: t.hit for t in tiles.covered(df.where("side = 'gen' and x is not null"), balls, keys=("label",), block=block).collect()}
    assert hit == {i: any(same[i, j] and side[j] == "real" and d[i, j] <= 2 for j in range(400)) for i in range(400) if side[i] == "gen"}


def test_equal_vectors_score_alike_wherever_they_stand(spark):
    x = np.repeat(np.random.default_rng(3).standard_normal((40, 33)), 5, axis=0)
    df = frame(spark, x)
    for metric in ("l2", "cos", "dot"):
        found = tiles.nearest(df, df, 3, metric=metric, block=17).collect()
        if metric != "dot":
            assert {(t.id, t.place): t.neighbour for t in found} == {(i, p): i // 5 * 5 + p - 1 for i in range(200) for p in (1, 2, 3)}
        assert all(len({t.score for t in found if t.id == i}) == 1 for i in range(0, 200, 17)) or metric == "dot"
    assert all(t.score == 0 for t in tiles.nearest(df, df, 3, block=64).collect())


def test_carried_columns(spark, cloud):
    df = frame(spark, cloud, label=[i % 7 for i in range(120)])
    found = tiles.nearest(df.where("id < 9"), df, 2, carried=("label", "side"), block=31).collect()
    assert len(found) == 18 and all(t.label == t.neighbour % 7 and t.side == "real" for t in found)


def test_info_nce_at_a_low_temperature(spark):
    r = np.random.default_rng(4)
    q, pos, neg = r.normal(size=(20, 4)), r.normal(size=(20, 4)), r.normal(size=(500, 4))
    queries = spark.createDataFrame([(i, q[i].tolist(), pos[i].tolist()) for i in range(20)], "id long, q array<double>, positive array<double>")
    bank = spark.createDataFrame([(i, x) for i, x in enumerate(neg.tolist())], "id long, x array<double>")
    u, p, n = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, pos, neg))
    s = np.c_[(u * p).sum(axis=1), u @ n.T] / 0.001
    want = s.max(axis=1) + np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) - s[:, 0]
    got = {x.id: x.loss for x in M.info_nce(queries, bank, 0.001, block=64).collect()}
    assert np.allclose([got[i] for i in range(20)], want)
    assert {x.loss for x in M.info_nce(queries, bank.limit(0), 0.2).collect()} == {0.0}


def test_tiles_of_empty_sides(spark, cloud):
    df = frame(spark, cloud)
    assert tiles.nearest(df, df.limit(0), 3).count() == 0 and tiles.nearest(df.limit(0), df, 3).count() == 0
    assert {t.hit for t in tiles.covered(df, df.limit(0).withColumn("r", F.lit(1.0))).collect()} == {False}


def test_linear_probe_equals_numpy(spark):
    from fathomry.operators.probe import linear_probe

    r = np.random.default_rng(8)
    y = r.integers(0, 4, 300)
    x = r.standard_normal((300, 5)) + np.eye(5)[y] * 1.5
    rows = [(v.tolist(), int(k)) for v, k in zip(x, y)]
    df = spark.createDataFrame(rows + [(None, 1), ([0.0] * 5, None)], "x array<double>, label int")
    held = spark.createDataFrame(rows[:100] + [([0.0] * 5, 9)], "x array<double>, label int")
    got = {t.epochs: (t.top1, t.top5) for t in linear_probe(df.repartition(3), held, epochs=(1, 4, 20)).collect()}
    a, w = np.c_[np.ones(300), x], np.zeros((4, 6))
    v = np.zeros_like(w)
    for n in range(1, 21):
        p = np.exp(a @ w.T)
        p = p / p.sum(1, keepdims=True) - np.eye(4)[y]
        v = 0.9 * v - p.T @ a / 300
        w = w + v
        if n in got:
            assert np.allclose(got[n], [((a[:100] @ w.T).argmax(1) == y[:100]).sum() / 101, 100 / 101])
    assert sorted(got) == [1, 4, 20] and got[20][0] > got[1][0] - 0.05
    assert linear_probe(df.limit(0), held, epochs=(1,)).count() == 0


def test_presets_take_no_more_than_they_say(spark, monkeypatch):
    monkeypatch.setitem(M.PRESETS, "eqt50k_int", {"metric": "psnr", "pairs": 7})
    pairs = spark.createDataFrame([(i, float(i + 1), 0.0, 1) for i in range(40) for _ in range(3)], "id long, a double, b double, mask int")
    drawn = [r.id for r in manifest.seeded_subset(spark.range(40), "id", 0, 7).collect()]
    want = 20 * np.log10(2) - 10 * np.log10(np.mean([(i + 1) ** 2 for i in drawn]))
    assert len(drawn) == 7 and np.isclose(M.compute("eqt50k_int", pairs).first().psnr, want)
    monkeypatch.setitem(M.PRESETS, "is_512", {"metric": "is", "gen": 9, "splits": 1})
    seen = {}
    monkeypatch.setitem(M._REGISTRY, "is", lambda f, splits: seen.setdefault("ids", f))
    M.compute("is_512", spark.range(30).selectExpr("id", "'gen' AS side"))
    assert {r.id for r in seen["ids"].collect()} == {r.id for r in manifest.seeded_subset(spark.range(30), "id", 0, 9).collect()}


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_postings(spark, size):
    r = np.random.default_rng(2)
    rows = [(None if c == 3 else f"c{c}", int(i)) for i, c in zip(r.permutation(500), np.minimum(r.integers(0, 12, 500), 4))]
    items = spark.createDataFrame(rows, "class string, idx long").repartition(4)
    made = manifest.class_postings(items, size=size).collect()
    for c in {x for x, _ in rows}:
        mine = sorted((p for p in made if p["class"] == c), key=lambda p: p.chunk)
        want = sorted(i for x, i in rows if x == c)
        assert [i for p in mine for i in p.rows] == want and [p.first for p in mine] == list(np.cumsum([0, *[len(p.rows) for p in mine]])[:-1])
        assert size > 7 or max(len(p.rows) for p in mine) < 30
    at = spark.createDataFrame([("c0", 0), (None, 5), ("c4", 100), ("c1", 10_000)], "class string, place long")
    found = {(x["class"], x.place): x.idx for x in manifest.posting(manifest.class_postings(items, size=size), at).collect()}
    assert found == {(c, p): sorted(i for x, i in rows if x == c)[p] for c, p in (("c0", 0), (None, 5), ("c4", 100))}


def test_deduplication_stops_at_its_number(spark):
    cells = [(i, m, y, 0, 1 - m / 10) for i in range(2) for m in range(5) for y in range(m, m + 3)]
    df = spark.createDataFrame(cells, "image long, mask int, y int, x int, score double")
    assert sorted((r.image, r.mask) for r in masks.deduplicated(df, most_iou=0.4, keep=2).collect()) == [(i, m) for i in range(2) for m in (0, 2)]


def test_moments_of_many_keys(spark, cloud, monkeypatch):
    monkeypatch.setattr(moments, "HELD", 1000)
    df = frame(spark, cloud, label=[i % 40 for i in range(120)]).repartition(2)
    made = moments.merged(moments.partial(df, "label"), "label")
    got = {r.label: r["row"][0] for r in made.where("i = -2").collect()}
    assert got == {k: 3.0 for k in range(40)}
    with pytest.raises(ValueError, match="more than 16 keys"):
        moments.collected(made, "label")

"""Queries over feature sets, probabilities and logits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import feature_metrics as M
from ..operators import moments as G
from ..operators import tiles
from ..functions.scalars import rounded
from . import fixtures as X
from .registry import query


def r(name, digits=6):
    return rounded(name, digits).alias(name)


@query("a01_moments", X.COV + " SELECT c.side, c.i::INT AS i, c.j::INT AS j, round(a.mean, 8) AS mean_i, round(g - a.mean * b.mean, 8) AS cov FROM c JOIN m a ON a.side = c.side AND a.i = c.i JOIN m b ON b.side = c.side AND b.i = c.j", "features")
def a01(spark, sf):
    return G.covariance(G.merged(G.partial(X.features(spark, sf)))).select("side", "i", "j", r("mean_i", 8), r("cov", 8))


def _times(a: str, b: str) -> str:
    """The product of a matrix with a symmetric one, both lists of rows."""
    return f"list_transform({a}, lambda r: list_transform({b}, lambda c: list_inner_product(r, c)))"


def _trace(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda r, i: r[i]))"


def _root(name: str, source: str) -> str:
    """CTEs for the square root of the symmetric matrix m of a one-row table: coupled Newton-Schulz steps on m over its norm."""
    half = f"list_transform({_times('z', 'y')}, lambda r, i: list_transform(r, lambda v, j: (CASE WHEN i = j THEN 3 ELSE 0 END - v) / 2))"
    return f"""{name}_n AS (SELECT m, sqrt(list_sum(list_transform(m, lambda r: list_inner_product(r, r)))) AS norm FROM {source}),
{name}_s AS (SELECT 0 AS k, list_transform(m, lambda r: list_transform(r, lambda v: v / norm)) AS y, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END)) AS z FROM {name}_n
UNION ALL SELECT k + 1, {_times('y', 't')}, {_times('t', 'z')} FROM (SELECT *, {half} AS t FROM {name}_s WHERE k < 45)),
{name} AS (SELECT list_transform(y, lambda r: list_transform(r, lambda v: v * sqrt(norm))) AS m FROM {name}_s, {name}_n WHERE k = 45)"""


_LISTED = ", rows_ AS (SELECT c.side, c.i, list(g - a.mean * b.mean ORDER BY c.j) AS row FROM c JOIN m a ON a.side = c.side AND a.i = c.i JOIN m b ON b.side = c.side AND b.i = c.j GROUP BY ALL), cv AS (SELECT side, list(row ORDER BY i) AS m FROM rows_ GROUP BY side)"


def _frechet(digits: int) -> str:
    return (
        X.COV
        + _LISTED
        + ", ca AS (SELECT m FROM cv WHERE side = 'gen'), "
        + _root("ra", "ca")
        + f", mid AS (SELECT {_times(_times('ra.m', 'cv.m'), 'ra.m')} AS m FROM ra, cv WHERE side = 'real'), "
        + _root("rm", "mid")
        + f" SELECT round((SELECT sum((a.mean - b.mean) ** 2) FROM m a JOIN m b ON a.i = b.i WHERE a.side = 'gen' AND b.side = 'real') + (SELECT sum({_trace('m')}) FROM cv) - 2 * (SELECT {_trace('m')} FROM rm), {digits}) AS frechet"
    )


@query("a02_frechet", _frechet(6), "features")
def a02(spark, sf):
    return G.frechet_distance(X.features(spark, sf)).select(r("frechet"))


@query("a02b_mean_gap", X.COV + " SELECT round(sum((a.mean - b.mean) ** 2), 8) AS gap FROM m a JOIN m b ON a.i = b.i WHERE a.side = 'gen' AND b.side = 'real'", "features")
def a02b(spark, sf):
    means = G.covariance(G.merged(G.partial(X.features(spark, sf)))).where("j = 0").select("side", "i", "mean_i")
    a, b = (means.where(F.col("side") == k).select("i", F.col("mean_i").alias(k)) for k in ("gen", "real"))
    return a.join(b, "i").agg(F.round(F.sum((F.col("gen") - F.col("real")) ** 2), 8).alias("gap"))


@query("a03_kid", """, z AS (SELECT least(1000, min(c)) AS m FROM (SELECT count(*) AS c FROM features GROUP BY side)),
d AS (SELECT * FROM (SELECT s, id, side, x, row_number() OVER (PARTITION BY s, side ORDER BY md5(s || ':' || id), id) AS k FROM features, generate_series(0, 99) AS g(s)) WHERE k <= (SELECT m FROM z)),
k AS (SELECT a.s, a.side AS p, b.side AS q, sum((list_inner_product(a.x, b.x) / 64 + 1) ** 3) AS v FROM d a JOIN d b ON a.s = b.s AND (a.side <> b.side OR a.id <> b.id) GROUP BY ALL)
SELECT round(sum(CASE WHEN p = q THEN v / (m - 1) ELSE -v / m END) / (100 * any_value(m)), 8) AS kid FROM k, z""", "features")
def a03(spark, sf):
    return M.kernel_distance(X.features(spark, sf), subsets=100, m=1000).select(r("kid", 8))


@query("a04_inception_score", """, o AS (SELECT p, row_number() OVER (ORDER BY ord) - 1 AS k, count(*) OVER () AS n FROM probs), s AS (SELECT p, i FROM o, generate_series(0, 4) AS g(i) WHERE k >= i * n // 5 AND k < (i + 1) * n // 5),
l AS (SELECT i, c, p[c] AS v FROM s, unnest(generate_series(1, 10)) AS h(c)), m AS (SELECT i, c, avg(v) AS m, sum(v * ln(v)) AS e, count(*) AS n FROM l GROUP BY ALL), z AS (SELECT i, exp(sum(e - n * m * ln(m)) / max(n)) AS s FROM m GROUP BY i)
SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM z""", "features logits probs")
def a04(spark, sf):
    return M.inception_score(X.probs(spark, sf), 5).select(r("mean"), r("std"))


def _manifold(extra: str, same: str) -> str:
    return f""", d AS (SELECT a.id, b.id AS o, a.side, a.label, list_distance(a.x, b.x) AS d FROM features a JOIN features b ON a.side = b.side {same}),
rad AS (SELECT id, side, label, d AS r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM d) WHERE k = 4),
h AS (SELECT a.id, a.side, a.label, bool_or(list_distance(a.x, b.x) <= rad.r) AS hit FROM features a JOIN features b ON a.side <> b.side {same} JOIN rad ON rad.id = b.id GROUP BY ALL)
{extra}"""


@query("a05_precision_recall", _manifold("SELECT round(avg(hit::INT) FILTER (WHERE side = 'gen'), 6) AS precision, round(avg(hit::INT) FILTER (WHERE side = 'real'), 6) AS recall FROM h", ""), "features")
def a05(spark, sf):
    return M.precision_recall(X.features(spark, sf)).select(r("precision"), r("recall"))


_A6 = _manifold("SELECT label, round(avg(hit::INT) FILTER (WHERE side = 'gen'), 6) AS precision, round(avg(hit::INT) FILTER (WHERE side = 'real'), 6) AS recall FROM h GROUP BY label", "AND a.label = b.label")


@query("a06_class_precision_recall", _A6, "features")
def a06(spark, sf):
    return M.class_precision_recall(X.features(spark, sf)).select("label", r("precision"), r("recall"))


@query("a07_macro", ", c AS (SELECT name, avg(value) AS v FROM telemetry GROUP BY run, name) SELECT name, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std FROM c GROUP BY name", "telemetry")
def a07(spark, sf):
    c = X.telemetry(spark, sf).groupBy("run", "name").agg(F.avg("value").alias("v"))
    return c.groupBy("name").agg(F.round(F.avg("v"), 6).alias("v_mean"), F.round(F.stddev_pop("v"), 6).alias("v_std"))


@query("a08_trimmed_mean", ", d AS (SELECT l_extendedprice AS d, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem), e AS (SELECT min(d) FILTER (WHERE k = floor((n - 1) * 0.01)) AS lo, min(d) FILTER (WHERE k = ceil((n - 1) * 0.99)) AS hi FROM d) SELECT round(avg(d), 4) AS mean FROM d, e WHERE d BETWEEN lo AND hi".replace(", d AS", "WITH d AS", 1))
def a08(spark, sf):
    d = X.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("d"))
    return M.trimmed_mean(d, "d", "l_orderkey").select(r("mean", 4))


@query("a13_top_k", ", h AS (SELECT target, list_sum(list_transform(z, lambda v, i: ((v > z[target + 1]) OR (v = z[target + 1] AND i < target + 1))::INT)) AS ahead FROM logits) SELECT round(avg((ahead < 1)::INT), 6) AS top1, round(avg((ahead < 5)::INT), 6) AS top5 FROM h", "features logits")
def a13(spark, sf):
    return X.logits(spark, sf).agg(*[F.round(F.avg(M.top_k_hit("z", "target", k).cast("double")), 6).alias(f"top{k}") for k in (1, 5)])


_KNN = """, q AS (SELECT * FROM features WHERE id % 5 = 0), b AS (SELECT * FROM features WHERE id % 5 <> 0), s AS (SELECT q.id, q.label AS target, b.label, list_cosine_similarity(q.x, b.x) AS s, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.x, b.x) DESC, b.id) AS k FROM q, b)"""


@query("a14_knn_classifier", _KNN + ", v AS (SELECT id, target, label, sum(exp(s / 0.1)) AS vote FROM s WHERE k <= 20 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vote DESC, label) AS place FROM v) SELECT round(count(*) FILTER (WHERE place <= 1 AND label = target) / count(DISTINCT id), 6) AS top1, round(count(*) FILTER (WHERE place <= 5 AND label = target) / count(DISTINCT id), 6) AS top5 FROM p", "features")
def a14(spark, sf):
    f = X.features(spark, sf)
    q, b = f.where("id % 5 = 0"), f.where("id % 5 <> 0")
    out = M.accuracy_at(M.knn_votes(q, b, k=20), q.select("id", F.col("label").alias("target")))
    return out.select(r("top1"), r("top5"))


_PROBE = f""", tr AS (SELECT list(list_prepend(1.0::DOUBLE, x) ORDER BY id) AS xs, list(label ORDER BY id) AS ys, max(label) + 1 AS c FROM features WHERE id % 5 <> 0),
xt AS (SELECT *, list_transform(range(1, 66), lambda i: list_transform(xs, lambda v: v[i])) AS xt, list_transform(range(0, c), lambda k: list_transform(range(1, 66), lambda i: 0.0::DOUBLE)) AS zero FROM tr),
gd AS (SELECT 0 AS k, zero AS w, zero AS v FROM xt
UNION ALL SELECT k + 1, list_transform(w, lambda a, i: list_transform(a, lambda b, j: b + n[i][j])), n FROM (
  SELECT k, w, list_transform(v, lambda a, i: list_transform(a, lambda b, j: 0.9 * b - list_inner_product(rt[i], xt[j]) / len(xs))) AS n, xt FROM (
    SELECT k, w, v, xs, xt, list_transform(range(1, c + 1), lambda i: list_transform(p, lambda q, n: q[i] / list_sum(q) - (ys[n] = i - 1)::INT)) AS rt FROM (
      SELECT *, list_transform({_times('xs', 'w')}, lambda z: list_transform(z, lambda u: exp(u))) AS p FROM gd, xt WHERE k < 10)))),
te AS (SELECT k AS epochs, label, list_transform(w, lambda a: list_inner_product(a, list_prepend(1.0::DOUBLE, x))) AS z FROM gd, features WHERE k IN (2, 5, 10) AND id % 5 = 0),
ah AS (SELECT epochs, list_sum(list_transform(z, lambda u, i: (u > z[label + 1] OR u = z[label + 1] AND i <= label)::INT)) AS ahead FROM te)
SELECT epochs, round(avg((ahead < 1)::INT), 6) AS top1, round(avg((ahead < 5)::INT), 6) AS top5 FROM ah GROUP BY epochs"""


@query("a15_linear_probe", _PROBE, "features")
def a15(spark, sf):
    from ..operators.probe import linear_probe

    f = X.features(spark, sf)
    return linear_probe(f.where("id % 5 <> 0"), f.where("id % 5 = 0"), epochs=(2, 5, 10)).select("epochs", r("top1"), r("top5"))


@query("a17_contrastive_accuracy", """, p AS (SELECT a.id // 2 AS id, a.id // 2 // 16 AS batch, a.x AS a, b.x AS b FROM features a JOIN features b ON b.id = a.id + 1 WHERE a.id % 2 = 0),
s AS (SELECT u.batch, u.id AS i, v.id AS j, list_cosine_similarity(u.a, v.b) AS s FROM p u JOIN p v ON u.batch = v.batch), h AS (SELECT batch, i, j, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) AS f, row_number() OVER (PARTITION BY batch, j ORDER BY s DESC, i) AS g FROM s),
a AS (SELECT batch, (sum((f = 1)::INT) + sum((g = 1)::INT)) / 2.0 / count(*) AS acc FROM h WHERE i = j GROUP BY batch) SELECT round(avg(acc), 6) AS accuracy FROM a""", "features")
def a17(spark, sf):
    f = X.features(spark, sf)
    pair = f.where("id % 2 = 0").select(F.floor(F.col("id") / 2).alias("id"), F.col("x").alias("a")).join(f.where("id % 2 = 1").select(F.floor(F.col("id") / 2).alias("id"), F.col("x").alias("b")), "id")
    return M.contrastive_accuracy(pair.withColumn("batch", F.floor(F.col("id") / 16))).select(r("accuracy"))


@query("a18_correlation", X.COV + " SELECT side, i::INT AS i, j::INT AS j, round(s, 8) AS cov FROM c", "features")
def a18(spark, sf):
    return G.covariance(G.merged(G.partial(X.features(spark, sf))), sample=True).select("side", "i", "j", r("cov", 8))


_DESCRIBED = f""", l AS (SELECT id, i, x[i] AS v FROM features, unnest(generate_series(1, 64)) AS g(i)), c AS (SELECT a.i, b.i AS j, corr(a.v, b.v) AS r, sum(a.v * b.v) AS g FROM l a JOIN l b ON a.id = b.id GROUP BY ALL), s AS (SELECT i, stddev_samp(v) AS d FROM l GROUP BY i),
g AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS row FROM c GROUP BY i)),
pw AS (SELECT 0 AS k, m AS p FROM g UNION ALL SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda v: v / t)) FROM (SELECT k, q, {_trace('q')} AS t FROM (SELECT k, {_times('p', 'p')} AS q FROM pw WHERE k < 14))),
el AS (SELECT 1 AS k, list_transform(m, lambda r, i: list_transform(r, lambda v, j: v - CASE WHEN i = j THEN 0.01 ELSE 0 END)) AS m, 0 AS n FROM g
UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i <= k THEN r ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END), n + (m[k][k] > 0)::INT FROM el WHERE k <= 64),
o AS (SELECT round(avg(abs(r)), 6) AS mean_corr FROM c WHERE i <> j)
SELECT mean_corr, mean_corr AS nansafe_corr, (SELECT n FROM el WHERE k = 65)::BIGINT AS rank, (SELECT n / least(64, (SELECT count(*) FROM features)) FROM el WHERE k = 65) AS rank_ratio, round((SELECT avg(d) FROM s), 6) AS mean_std,
round((SELECT {_trace(_times('m', 'p'))} / {_trace('p')} / {_trace('m')} FROM g, pw WHERE k = 14), 6) AS anisotropy FROM o"""


@query("a19_descriptors", _DESCRIBED, "features")
def a19(spark, sf):
    return G.descriptors(X.features(spark, sf)).select(r("mean_corr"), r("nansafe_corr"), "rank", "rank_ratio", r("mean_std"), r("anisotropy"))


@query("a19b_mean_correlation", ", l AS (SELECT id, i, x[i] AS v FROM features, unnest(generate_series(1, 64)) AS g(i)), c AS (SELECT a.i, b.i AS j, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.id = b.id WHERE a.i <> b.i GROUP BY ALL), s AS (SELECT i, stddev_samp(v) AS d FROM l GROUP BY i) SELECT round((SELECT avg(abs(r)) FROM c), 6) AS mean_corr, round((SELECT avg(abs(r)) FROM c), 6) AS nansafe_corr, round((SELECT avg(d) FROM s), 6) AS mean_std", "features")
def a19b(spark, sf):
    return G.descriptors(X.features(spark, sf)).select(r("mean_corr"), r("nansafe_corr"), r("mean_std"))


@query("a28_cross_entropy", ", l AS (SELECT *, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS lse FROM logits) SELECT round(avg(lse - z[target + 1]), 6) AS ce, round(avg(0.9 * (lse - z[target + 1]) + 0.1 * (lse - list_avg(z))), 6) AS smoothed FROM l", "features logits")
def a28(spark, sf):
    return X.logits(spark, sf).agg(F.round(F.avg(M.cross_entropy("z", "target")), 6).alias("ce"), F.round(F.avg(M.cross_entropy("z", "target", 0.1)), 6).alias("smoothed"))


@query("a29_info_nce", ", q AS (SELECT a.id, a.x AS q, b.x AS pos FROM features a JOIN features b ON b.id = a.id + 1 WHERE a.side = 'real'), n AS (SELECT x FROM features WHERE label = 3 AND side = 'gen') SELECT id, round(ln(exp(any_value(list_cosine_similarity(q, pos) / 0.2)) + sum(exp(list_cosine_similarity(q, x) / 0.2))) - any_value(list_cosine_similarity(q, pos) / 0.2), 6) AS loss FROM q, n GROUP BY id", "features")
def a29(spark, sf):
    f = X.features(spark, sf)
    q = f.where("side = 'real'").select("id", F.col("x").alias("q")).join(f.select((F.col("id") - 1).alias("id"), F.col("x").alias("positive")), "id")
    return M.info_nce(q, f.where("label = 3 and side = 'gen'").select("id", "x"), 0.2).select("id", r("loss"))


@query("a30_feature_matching", "SELECT round(avg(1 - list_cosine_similarity(a.x, b.x)), 6) AS loss FROM features a JOIN features b ON b.id = a.id + 1 WHERE a.side = 'real'", "features")
def a30(spark, sf):
    f = X.features(spark, sf)
    pair = f.where("side = 'real'").select("id", F.col("x").alias("a")).join(f.select((F.col("id") - 1).alias("id"), F.col("x").alias("b")), "id")
    return pair.agg(F.round(F.avg(1 - V.cosine("a", "b")), 6).alias("loss"))


@query("a31_masked_l1", "SELECT round(sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: CASE WHEN abs(z[1] - z[2]) < 1 THEN 0.5 * (z[1] - z[2]) ** 2 ELSE abs(z[1] - z[2]) - 0.5 END)) * (a.id % 3 = 0)::INT) / (sum((a.id % 3 = 0)::INT) + 1e-8), 6) AS loss FROM features a JOIN features b ON b.id = a.id + 1", "features")
def a31(spark, sf):
    f = X.features(spark, sf)
    pair = f.select("id", F.col("x").alias("a")).join(f.select((F.col("id") - 1).alias("id"), F.col("x").alias("b")), "id")
    return M.masked_smooth_l1(pair.withColumn("mask", (F.col("id") % 3 == 0).cast("int"))).select(r("loss"))


_PAIRS = ", k AS (SELECT id, x, row_number() OVER (ORDER BY md5('5:' || id), id) - 1 AS k FROM features)"


@query("j13_random_pairs", _PAIRS + " SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON b.k = a.k + 1 WHERE a.k % 2 = 0", "features")
def j13(spark, sf):
    return M.random_pairs(X.features(spark, sf), "id", 5)


@query("a34_diversity", _PAIRS + " SELECT round(avg(list_cosine_similarity(a.x, b.x)), 6) AS similarity FROM k a JOIN k b ON b.k = a.k + 1 WHERE a.k % 2 = 0", "features")
def a34(spark, sf):
    f = X.features(spark, sf)
    pairs = M.random_pairs(f, "id", 5)
    a, b = f.select(F.col("id").alias("a"), F.col("x").alias("xa")), f.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    return pairs.join(a, "a").join(b, "b").agg(F.round(F.avg(V.cosine("xa", "xb")), 6).alias("similarity"))


@query("a35_view_stats", "SELECT min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean FROM (SELECT unnest(x) AS v FROM features)", "features")
def a35(spark, sf):
    return X.features(spark, sf).agg(F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most"), F.round(F.sum(V.total("x")) / F.sum(F.size("x")), 6).alias("mean"))


@query("a36_merge", X.COV + " SELECT m.side, i::INT AS i, round(mean, 8) AS mean FROM m", "features")
def a36(spark, sf):
    f = X.features(spark, sf)
    stored = G.merged(G.partial(f.where("label < 5"))).unionByName(G.merged(G.partial(f.where("label >= 5"))))
    return G.covariance(G.merged(stored)).where("j = 0").select("side", "i", F.round("mean_i", 8).alias("mean"))


@query("a37_view_terms", """, p AS (SELECT a.id, a.x AS a, b.x AS b FROM features a JOIN features b ON b.id = a.id + 1 WHERE a.id % 2 = 0), l AS (SELECT id, 'a' AS side, i, a[i] AS v FROM p, unnest(generate_series(1, 64)) AS g(i) UNION ALL SELECT id, 'b', i, b[i] FROM p, unnest(generate_series(1, 64)) AS g(i)),
c AS (SELECT u.side, u.i, w.i AS j, covar_samp(u.v, w.v) AS c FROM l u JOIN l w ON u.id = w.id AND u.side = w.side GROUP BY ALL)
SELECT round((SELECT avg(list_distance(a, b) ** 2 / 64) FROM p), 6) AS invariance, round((SELECT sum(greatest(0, 1 - sqrt(c + 1e-4))) / 64 / 2 FROM c WHERE i = j), 6) AS variance, round((SELECT sum(c * c) / 64 FROM c WHERE i <> j), 6) AS covariance""", "features")
def a37(spark, sf):
    f = X.features(spark, sf)
    pair = f.where("id % 2 = 0").select("id", F.col("x").alias("a")).join(f.select((F.col("id") - 1).alias("id"), F.col("x").alias("b")), "id")
    return G.view_terms(pair).select(r("invariance"), r("variance"), r("covariance"))


@query("j07_distances", "SELECT a.id, b.id AS neighbour, round(list_distance(a.x, b.x), 6) AS d FROM features a JOIN features b ON a.side = 'gen' AND b.side = 'real' AND a.label = b.label", "features")
def j07(spark, sf):
    f = X.features(spark, sf)
    sides = [f.where(F.col("side") == s).select("label", "id", "x") for s in ("gen", "real")]
    found = tiles.all_pairs(*sides, keys=("label",), value=lambda s: tiles.half_up(np.sqrt(-s), 6))
    return found.select("id", "neighbour", F.col("score").alias("d"))


@query("j08_within", _manifold("SELECT id, hit FROM h WHERE side = 'gen'", "AND a.label = b.label"), "features")
def j08(spark, sf):
    f = X.features(spark, sf)
    real = f.where("side = 'real'")
    balls = real.join(tiles.radius(real, 3, keys=("label",)), ["label", "id"])
    return tiles.covered(f.where("side = 'gen'"), balls, keys=("label",), sized=real).select("id", "hit")


@query("j09_batch_cosine", ", p AS (SELECT id, id // 16 AS batch, x FROM features) SELECT u.batch, u.id, v.id AS other, round(list_cosine_similarity(u.x, v.x), 6) AS s FROM p u JOIN p v ON u.batch = v.batch", "features")
def j09(spark, sf):
    p = X.features(spark, sf).select("id", F.floor(F.col("id") / 16).alias("batch"), "x")
    found = tiles.nearest(p, p, 16, metric="cos", keys=("batch",))
    return found.select("batch", "id", F.col("neighbour").alias("other"), rounded("score", 6).alias("s"))


@query("j10_kernel_sums", ", p AS (SELECT id, side, label, x FROM features) SELECT u.label, u.side AS p, v.side AS q, round(sum((list_inner_product(u.x, v.x) / 64 + 1) ** 3), 4) AS s FROM p u JOIN p v ON u.label = v.label GROUP BY ALL", "features")
def j10(spark, sf):
    f = X.features(spark, sf).select("label", "id", "side", "x")
    sums = tiles.pair_sums(f, f, lambda dots: (dots / 64 + 1) ** 3, "side", keys=("label",))
    return sums.select("label", "p", "q", r("s", 4))


@query("j12_bank", ", q AS (SELECT id, x FROM features WHERE id % 5 = 0), b AS (SELECT id, x FROM features WHERE label = 0) SELECT q.id, b.id AS bank, round(list_inner_product(q.x, b.x), 6) AS s FROM q, b", "features")
def j12(spark, sf):
    f = X.features(spark, sf)
    found = tiles.all_pairs(f.where("id % 5 = 0"), f.where("label = 0"), metric="dot", value=lambda s: tiles.half_up(s, 6))
    return found.select("id", F.col("neighbour").alias("bank"), F.col("score").alias("s"))


@query("j14_mixup", ", r AS (SELECT id, x, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch, (row_number() OVER (ORDER BY id) - 1) % 32 AS k FROM features), n AS (SELECT batch, count(*) AS n FROM r GROUP BY batch) SELECT u.id, v.id AS partner, list_transform(list_zip(u.x, v.x), lambda z: round(0.7 * z[1] + (1 - 0.7) * z[2], 6)) AS x FROM r u JOIN n ON n.batch = u.batch JOIN r v ON v.batch = u.batch AND v.k = n - 1 - u.k", "features")
def j14(spark, sf):
    return M.mixup(X.features(spark, sf), 32, 0.7).select("id", "partner", F.transform("x", lambda v: rounded(v, 6)).alias("x"))


@query("o04_radius", ", d AS (SELECT a.id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS k FROM features a JOIN features b ON a.side = b.side) SELECT id, round(d, 6) AS r FROM d WHERE k = 4", "features")
def o04(spark, sf):
    f = X.features(spark, sf)
    return tiles.radius(f, 3, keys=("side",)).select("id", r("r"))


@query("o05_neighbours", _KNN + " SELECT id, round(sum(s), 6) AS s, count(*) AS n FROM s WHERE k <= 10 GROUP BY id", "features")
def o05(spark, sf):
    f = X.features(spark, sf)
    found = tiles.nearest(f.where("id % 5 = 0"), f.where("id % 5 <> 0"), 10, metric="cos")
    return found.groupBy("id").agg(F.round(F.sum("score"), 6).alias("s"), F.count(F.lit(1)).alias("n"))


@query("x02_preset_pr_cond", _A6.replace("SELECT label, round(", ", z AS (SELECT label, round(").replace("GROUP BY label", "GROUP BY label) SELECT round(avg(precision), 5) AS precision_mean, round(avg(recall), 5) AS recall_mean FROM z"), "features")
def x02(spark, sf):
    return M.compute("pr50k3_full_cond", X.features(spark, sf)).select(r("precision_mean", 5), r("recall_mean", 5))


@query("x04_extractor", "SELECT id, list_transform(x, lambda v: round(v * 2, 6)) AS x FROM features", "features")
def x04(spark, sf):
    import numpy as np
    import pyarrow as pa

    def twice(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = np.array(batch.column("x").to_pylist()) * 2
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(m.tolist())], names=["id", "x"])

    out = M.extracted(X.features(spark, sf).select("id", "x"), twice, "id long, x array<double>")
    return out.select("id", F.transform("x", lambda v: rounded(v, 6)).alias("x"))


@M.metric("mean_norm")
def mean_norm(features):
    """A user's metric: mean length of the vectors of each side."""
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return features.groupBy("side").agg(F.avg(F.sqrt(squares)).alias("mean_norm"))


@query("x01_registry", "SELECT side, round(avg(sqrt(list_sum(list_transform(x, lambda v: v * v)))), 6) AS mean_norm FROM features GROUP BY side", "features")
def x01(spark, sf):
    return M.registered("mean_norm")(X.features(spark, sf)).select("side", r("mean_norm"))


@query("x03_preset_fid10k", _frechet(6), "features")
def x03(spark, sf):
    return M.compute("fid10k_full", X.features(spark, sf)).select(r("frechet"))


@query("x05_row_transform", "SELECT id, label, list_transform(x, lambda v: round(v / sqrt(list_sum(list_transform(x, lambda u: u * u))), 6)) AS x FROM features", "features")
def x05(spark, sf):
    import numpy as np

    def unit(row: dict) -> dict:
        v = np.array(row["x"])
        return row | {"x": (v / np.sqrt(v @ v)).tolist()}

    out = M.transformed(X.features(spark, sf).select("id", "label", "x"), unit, "id long, label int, x array<double>")
    return out.select("id", "label", F.transform("x", lambda v: rounded(v, 6)).alias("x"))


@query("x03b_preset_equivariance", ", k AS (SELECT image, row_number() OVER (ORDER BY md5('0:' || image), image) AS k FROM (SELECT DISTINCT image FROM pixels)) SELECT round(20 * log10(2) - 10 * log10(sum((a.v - b.v) ** 2 * (a.x < 6)::INT) / sum((a.x < 6)::INT)), 6) AS psnr FROM pixels a JOIN pixels b ON b.image = a.image AND a.y = b.y AND a.x = 7 - b.x JOIN k ON k.image = a.image WHERE k <= 50000", "features pixels")
def x03b(spark, sf):
    p = X.pixels(spark, sf)
    pairs = p.select(F.col("image").alias("id"), "y", "x", F.col("v").alias("a")).join(p.select(F.col("image").alias("id"), "y", (7 - F.col("x")).alias("x"), F.col("v").alias("b")), ["id", "y", "x"])
    return M.compute("eqt50k_int", pairs.withColumn("mask", (F.col("x") < 6).cast("int"))).select(r("psnr"))


@query("x06_accumulator", X.COV + " SELECT c.side, c.i::INT AS i, c.j::INT AS j, round(a.mean, 8) AS mean_i, round(g - a.mean * b.mean, 8) AS cov FROM c JOIN m a ON a.side = c.side AND a.i = c.i JOIN m b ON b.side = c.side AND b.i = c.j", "features")
def x06(spark, sf):
    f = X.features(spark, sf)
    parts = [G.merged(G.partial(f.where(F.col("id") % 3 == k))) for k in range(3)]
    either = G.merged(parts[2].unionByName(G.merged(parts[1].unionByName(parts[0]))))  # in any order and grouping
    return G.covariance(either).select("side", "i", "j", r("mean_i", 8), r("cov", 8))


@query("x07_record_rows", ", c AS (SELECT label, side, count(*) AS n FROM features GROUP BY ALL) SELECT 'count_' || side AS metric, label AS class, n::DOUBLE AS value FROM c", "features")
def x07(spark, sf):
    from ..operators.telemetry import per_class

    key = F.concat(F.lit("count_"), "side", F.lit("_class_"), F.col("label").cast("string"))
    counts = X.features(spark, sf).groupBy("label", "side").agg(F.count(F.lit(1)).cast("double").alias("n"))
    record = counts.agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("results"))  # one entry for each class and side
    return per_class(record).select("metric", "class", "value")

"""Queries over manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import manifest as M
from . import fixtures as X
from .registry import query

_ML = "manifest label_file"
#: Rank by the MD5 of a seed and an id.
_RANK = "row_number() OVER (ORDER BY md5('{0}:' || idx), idx) - 1"


@query("j01_labels_left", "SELECT idx, m.path, l.label FROM manifest m LEFT JOIN label_file l ON m.path = l.path", _ML)
def j01(spark, sf):
    return M.attach_labels(X.manifest(spark, sf), X.label_file(spark, sf)).select("idx", "path", "label")


@query("j02_labels_required", "SELECT idx, m.path, l.label FROM manifest m JOIN label_file l ON m.path = l.path", _ML)
def j02(spark, sf):
    labels = X.label_file(spark, sf)
    return M.require_labels(X.manifest(spark, sf).join(labels.select("path"), "path", "left_semi"), labels).select("idx", "path", "label")


@query("j03_subset", ", c AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS index FROM (SELECT DISTINCT class FROM manifest)) SELECT idx, split_part(path, '/', 3) AS name, m.class, index FROM manifest m JOIN c ON m.class = c.class WHERE width = 64", "manifest")
def j03(spark, sf):
    m = X.manifest(spark, sf).withColumn("name", S.basename(F.col("path")))
    return M.subset_by_list(m, m.where("width = 64").select("name"), M.class_index(m)).select("idx", "name", "class", F.col("index").cast("long").alias("index"))


@query("j05_rehome", "SELECT split_part(path, '/', 3) AS name, class, class || '/images/' || split_part(path, '/', 3) AS target FROM manifest WHERE width < 128", "manifest")
def j05(spark, sf):
    m = X.manifest(spark, sf).withColumn("name", S.basename(F.col("path")))
    return M.rehome(m.where("width < 128").select("name"), m.select("name", "class"))


@query("j06_not_done", "SELECT idx, path FROM manifest WHERE path NOT IN (SELECT path FROM label_file)", _ML)
def j06(spark, sf):
    return M.not_done(X.manifest(spark, sf), X.label_file(spark, sf), "path").select("idx", "path")


@query("j15_positional", ", a AS (SELECT idx, class, row_number() OVER (ORDER BY idx) - 1 AS k FROM manifest), b AS (SELECT width, row_number() OVER (ORDER BY idx) - 1 AS k FROM manifest) SELECT idx, class, width, a.k AS rank FROM a JOIN b ON a.k = b.k", "manifest")
def j15(spark, sf):
    m = X.manifest(spark, sf)
    left, right = M.order_rank(m.select("idx", "class"), "idx"), M.order_rank(m.select("idx", "width"), "idx").drop("idx")
    return left.join(right, "rank")


@query("w09_class_index", "SELECT class, row_number() OVER (ORDER BY class) - 1 AS index FROM (SELECT DISTINCT class FROM manifest)", "manifest")
def w09(spark, sf):
    return M.class_index(X.manifest(spark, sf)).select("class", F.col("index").cast("long").alias("index"))


@query("p14_class_subset", "SELECT idx, class FROM manifest WHERE class IN ('src0', 'src3')", "manifest")
def p14(spark, sf):
    return M.class_subset(X.manifest(spark, sf), ["src0", "src3"]).select("idx", "class")


@query("p18_violations", """, u AS (SELECT width AS uw, height AS uh, channels AS uc FROM manifest GROUP BY ALL ORDER BY count(*) DESC, uw, uh, uc LIMIT 1)
SELECT idx, 'shape' AS problem FROM manifest, u WHERE (width, height, channels) <> (uw, uh, uc) UNION ALL SELECT idx, 'square' FROM manifest WHERE width <> height UNION ALL SELECT idx, 'power' FROM manifest WHERE bit_count(width) <> 1""", "manifest")
def p18(spark, sf):
    return M.violations(X.manifest(spark, sf))


@query("a26_class_support", "SELECT class, list(idx ORDER BY idx) AS rows, count(*) AS n, min(count(*)) OVER () AS least FROM manifest GROUP BY class", "manifest")
def a26(spark, sf):
    return M.class_support(X.manifest(spark, sf))


@query("a26b_postings", "SELECT class, row_number() OVER (PARTITION BY class ORDER BY idx) - 1 AS place, idx FROM manifest", "manifest")
def a26b(spark, sf):
    made = M.class_postings(X.manifest(spark, sf), size=20)
    return made.select("class", "first", F.posexplode("rows").alias("at", "idx")).select("class", (F.col("first") + F.col("at")).alias("place"), "idx")


@query("a26c_posting_lookup", ", r AS (SELECT class, idx, row_number() OVER (PARTITION BY class ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY class) AS n FROM manifest) SELECT class, place, idx FROM r WHERE place = n // 2", "manifest")
def a26c(spark, sf):
    items = X.manifest(spark, sf)
    middle = items.groupBy("class").agg(F.floor(F.count(F.lit(1)) / 2).alias("place"))
    return M.posting(M.class_postings(items, size=20), middle)


@query("a27_label_shape", "SELECT (max(l.label) + 1)::BIGINT AS classes, bool_or(l.label IS NOT NULL) AS labelled FROM manifest m LEFT JOIN label_file l ON m.path = l.path", _ML)
def a27(spark, sf):
    return M.label_shape(M.attach_labels(X.manifest(spark, sf), X.label_file(spark, sf)))


@query("d01_shards", ", r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n FROM manifest), a AS (SELECT idx, k + lap * n AS pos, lap FROM r, generate_series(0, 1) AS g(lap) WHERE k + lap * n < ceil(n / 7.0) * 7) SELECT idx, (pos % 7)::INT AS shard, pos // 7 AS place, lap > 0 AS wrapped FROM a", "manifest")
def d01(spark, sf):
    return M.shard_by_rank(X.manifest(spark, sf), "idx", 7)


@query("d02_batches", ", r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n FROM manifest) SELECT idx, k // 48 AS batch FROM r WHERE k < n // 48 * 48", "manifest")
def d02(spark, sf):
    return M.batches(X.manifest(spark, sf).select("idx"), "idx", 48, drop_last=True)


@query("d03_epochs", f"SELECT idx, {_RANK.format('5:2')} AS place FROM manifest", "manifest")
def d03(spark, sf):
    return M.epoch_order(X.manifest(spark, sf).select("idx"), "idx", 5, 2)


@query("d04_subset", f"SELECT idx, path FROM (SELECT idx, path, {_RANK.format(3)} AS k FROM manifest) WHERE k < 100", "manifest")
def d04(spark, sf):
    return M.seeded_subset(X.manifest(spark, sf).select("idx", "path"), "idx", 3, 100)


@query("d05_split", f"SELECT idx, CASE WHEN k < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM (SELECT idx, {_RANK.format(4)} AS k, count(*) OVER () AS n FROM manifest)", "manifest")
def d05(spark, sf):
    return M.exact_split(X.manifest(spark, sf).select("idx"), "idx", 4, 0.8)


@query("d06_mirror", "SELECT idx, false AS flip FROM manifest UNION ALL SELECT idx, true FROM manifest", "manifest")
def d06(spark, sf):
    return M.mirrored(X.manifest(spark, sf).select("idx"))


@query("d07_draw_labels", ", r AS (SELECT label, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM features) SELECT i AS draw, label FROM generate_series(0, 999) AS g(i), r WHERE k = ('0x' || substr(md5('6:' || i), 1, 8))::BIGINT % n", "features")
def d07(spark, sf):
    return M.draw_labels(X.features(spark, sf), "label", "id", 6, 1000)


@query("d08_subsets", "SELECT subset, id, side FROM (SELECT s AS subset, id, side, row_number() OVER (PARTITION BY s, side ORDER BY md5(s || ':' || id), id) AS k FROM features, generate_series(0, 4) AS g(s)) WHERE k <= 50", "features")
def d08(spark, sf):
    return M.random_subsets(X.features(spark, sf).select("id", "side"), "id", 5, 50, ("side",)).select(F.col("subset").cast("long").alias("subset"), "id", "side")


def _drawn(tag: str) -> str:
    return f"('0x' || substr(md5('0:' || {tag}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _size(low: str, high: str, a: str, b: str, u: str, op: str) -> str:
    area, ratio = f"floor(196 * ({low}::DOUBLE + {u} * ({high}::DOUBLE - {low}::DOUBLE)))", f"({a}::DOUBLE + {u} * ({b}::DOUBLE - {a}::DOUBLE))"
    return f"least(13, round(sqrt({area} {op} {ratio})))::INT"


_IN = "p // 14 >= {0}.y AND p // 14 < {0}.y + {0}.h AND p % 14 >= {0}.x AND p % 14 < {0}.x + {0}.w"


@query("d09_multiblock", f""", b AS (SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 64 AS batch FROM manifest), u AS (SELECT batch, {_drawn("batch || ':target'")} AS t, {_drawn("batch || ':context'")} AS c FROM (SELECT DISTINCT batch FROM b)),
z AS (SELECT batch, {_size("0.15", "0.2", "0.75", "1.5", "t", "*")} AS th, {_size("0.15", "0.2", "0.75", "1.5", "t", "/")} AS tw, {_size("0.85", "1.0", "1.0", "1.0", "c", "*")} AS ch, {_size("0.85", "1.0", "1.0", "1.0", "c", "/")} AS cw FROM u),
t AS (SELECT idx, batch, ch, cw, list({{'y': floor({_drawn("idx || ':t' || i || ':0:y'")} * (14 - th))::INT, 'x': floor({_drawn("idx || ':t' || i || ':0:x'")} * (14 - tw))::INT, 'h': th, 'w': tw}} ORDER BY i) AS ts FROM b JOIN z USING (batch), generate_series(0, 3) AS g(i) GROUP BY ALL),
c AS (SELECT idx, a, ts[1:4 - a // 20] AS ts, {{'y': floor({_drawn("idx || ':c0:' || a || ':y'")} * (14 - ch))::INT, 'x': floor({_drawn("idx || ':c0:' || a || ':x'")} * (14 - cw))::INT, 'h': ch, 'w': cw}} AS k FROM t, generate_series(0, 99) AS g(a)),
m AS (SELECT idx, a, list_filter(range(0, 196), lambda p: {_IN.format("k")} AND len(list_filter(ts, lambda q: {_IN.format("q")})) = 0) AS cells FROM c),
o AS (SELECT idx, arg_min(cells, a) AS cells FROM m WHERE len(cells) > 10 GROUP BY idx)
SELECT idx, batch, [cells[1:min(len(cells)) OVER (PARTITION BY batch)]] AS contexts, list_transform(ts, lambda q: list_filter(range(0, 196), lambda p: {_IN.format("q")})) AS targets FROM t JOIN o USING (idx)""", "manifest")
def d09(spark, sf):
    return M.multiblock_masks(X.manifest(spark, sf), "idx")


@query("d10_random_masks", ", r AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY md5('8:' || id || ':' || p), p) AS k FROM features, generate_series(0, 48) AS g(p)) SELECT id, list(p::INT ORDER BY p) AS kept, any_value(CASE WHEN ('0x' || substr(md5('9:' || id), 1, 8))::BIGINT / 4294967296.0 < 0.75 THEN 'block' ELSE 'random' END) AS strategy FROM r WHERE k <= 20 GROUP BY id", "features")
def d10(spark, sf):
    return M.random_patches(X.features(spark, sf), "id", 49, 0.6, 8).withColumn("strategy", M.mixed_strategy("id", 9))


@query("w13_label_grid", """, l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS li, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM features)), m AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('2:' || id), id) - 1 AS k, count(*) OVER (PARTITION BY label) AS size FROM features)
SELECT y::INT AS y, x::INT AS x, m.label, id FROM generate_series(0, 23) AS g(y), generate_series(0, 7) AS h(x), l JOIN m ON l.label = m.label WHERE li = y % n AND k = (8 * (y // n) + x) % size""", "features")
def w13(spark, sf):
    return M.label_grid(X.features(spark, sf), "label", "id", 2, 8, 24)


@query("k02_archive_names", "SELECT idx, lpad(idx::VARCHAR, 8, '0')[1:5] || '/img' || lpad(idx::VARCHAR, 8, '0') || '.png' AS name, CASE WHEN bool_and(l.label IS NOT NULL) OVER () THEN l.label END AS label FROM manifest m LEFT JOIN label_file l ON m.path = l.path", _ML)
def k02(spark, sf):
    return M.packed_names(X.manifest(spark, sf), X.label_file(spark, sf))


@query("u01_class_union", "SELECT label FROM features WHERE side = 'real' UNION SELECT label FROM features WHERE side = 'gen'", "features")
def u01(spark, sf):
    f = X.features(spark, sf)
    return f.where("side = 'real'").select("label").union(f.where("side = 'gen'").select("label")).distinct()


@query("u02_flagged_union", "SELECT id, label, false AS flipped FROM features UNION ALL SELECT id, label, true FROM features", "features")
def u02(spark, sf):
    return M.mirrored(X.features(spark, sf).select("id", "label")).withColumnRenamed("flip", "flipped")


@query("u06_concat", "SELECT id, label FROM features", "features")
def u06(spark, sf):
    f = X.features(spark, sf).select("id", "label")
    return f.where("id % 3 = 0").unionByName(f.where("id % 3 = 1")).unionByName(f.where("id % 3 = 2"))

"""Queries that write the given tables as the files of a training run and read them back."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import moments as G
from ..sources import readers as R
from ..sources import sinks
from . import fixtures as X
from .registry import query
from .stream_queries import folder


def _folders(spark, sf) -> str:
    """Manifest rows as files root/class=<class>/..., a few to each class."""
    root = folder(spark)
    X.manifest(spark, sf).select("class", F.col("path").alias("value")).repartition(4, "class").write.partitionBy("class").text(root)
    return root


@query("s01_class_folders", "SELECT 'class=' || class AS class, row_number() OVER (ORDER BY class) - 1 AS label, true AS has_files FROM (SELECT DISTINCT class FROM manifest)", "manifest")
def s01(spark, sf):
    return R.class_folders(spark, _folders(spark, sf)).groupBy("class", "label").agg((F.count(F.lit(1)) > 0).alias("has_files")).withColumn("label", F.col("label").cast("long"))


@query("s02_images", "SELECT path FROM manifest WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|bmp|webp|gif|tif|tiff|ppm)$')", "manifest")
def s02(spark, sf):
    return R.image_paths(X.manifest(spark, sf))


@query("s02b_images_limit", "SELECT path FROM (SELECT * FROM manifest UNION ALL SELECT * REPLACE (path || '.txt' AS path) FROM manifest) WHERE regexp_matches(lower(path), '\\.(png|jpg)$') ORDER BY path LIMIT 50", "manifest")
def s02b(spark, sf):
    m = X.manifest(spark, sf).select("path")
    return R.image_paths(m.union(m.select(F.concat("path", F.lit(".txt")))), 50)


@query("s03_label_file", "SELECT path, label FROM label_file", "manifest label_file")
def s03(spark, sf):
    root = folder(spark)
    labels = F.collect_list(F.array("path", F.col("label").cast("string"))).alias("labels")
    X.label_file(spark, sf).groupBy(F.substring_index("path", "/", 1)).agg(labels).select("labels").write.json(root)
    return R.label_file(spark, root, one_document=False)


@query("s04_annotations", "SELECT split_part(path, '/', 3) AS name, class, width AS x1 FROM manifest", "manifest")
def s04(spark, sf):
    root = folder(spark)
    rows = X.manifest(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"), "class", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    rows.write.csv(root, sep="\t")
    return R.annotations(spark, root).select("name", "class", "x1")


@query("s05_subset_list", "SELECT class || '_' || idx || '.JPEG' AS name, class FROM manifest", "manifest")
def s05(spark, sf):
    root = folder(spark)
    X.manifest(spark, sf).select(F.concat("class", F.lit("_"), F.col("idx").cast("string"), F.lit(".JPEG"))).write.text(root)
    return R.subset_list(spark, root)


@query("s06_metric_log", "SELECT name AS metric, round(avg(value), 6) AS value FROM telemetry GROUP BY name", "telemetry")
def s06(spark, sf):
    root = folder(spark)
    X.telemetry(spark, sf).groupBy(F.col("name").alias("metric")).agg(F.create_map(F.lit("v"), F.avg("value")).alias("results")).write.mode("append").json(root)
    return R.metric_log(spark, root).select("metric", F.round(F.try_element_at("results", F.lit("v")), 6).alias("value"))


@query("s08_iteration_csv", "SELECT run, step, value FROM telemetry", "telemetry")
def s08(spark, sf):
    root = folder(spark)
    X.telemetry(spark, sf).select("run", "step", "value").write.csv(root, header=True)
    return R.iteration_csv(spark, root, "run long, step long, value double").select("run", "step", "value")


@query("s09_representations", "SELECT 'l' || label || '.npz' AS path, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS row, list_transform(x, lambda v: round(v, 5)) AS x FROM features", "features")
def s09(spark, sf):
    """Vectors go out as contents of .npz files, one for each class, and come back row by row through the reader."""
    root = folder(spark)

    def pack(t):
        import pyarrow as pa

        t = t.sort_by("id")
        data = io.BytesIO()
        np.savez(data, reps=np.array(t.column("x").to_pylist(), np.float32)[:, :, None, None], labels=t.column("label").to_numpy())
        return pa.table({"path": pa.array([f"l{t.column('label')[0].as_py()}.npz"]), "content": pa.array([data.getvalue()], pa.binary())})

    X.features(spark, sf).select("id", "label", "x").groupBy("label").applyInArrow(pack, "path string, content binary").write.parquet(root)
    rows = R.unpacked_representations(spark.read.parquet(root))
    return rows.select("path", "row", F.transform("x", lambda v: rounded(v.cast("double"), 5)).alias("x"))


@query("s10_synthetic", ", h AS (SELECT id, list_transform(range(0, 64), lambda d: md5('0:' || id || ':' || d)) AS h FROM features) SELECT id, list_transform(h, lambda m: round((sqrt(-2 * ln(('0x' || substr(m, 1, 8))::BIGINT / 4294967296.0::DOUBLE + pow(2, -32))) * cos(2 * pi() * ('0x' || substr(m, 9, 8))::BIGINT / 4294967296.0::DOUBLE))::FLOAT::DOUBLE, 4)) AS x FROM h", "features")
def s10(spark, sf):
    return R.with_normal_vectors(X.features(spark, sf), "id", 64).select("id", F.transform("x", lambda v: rounded(v.cast("double"), 4)).alias("x"))


@query("k01_packed", "SELECT idx, path, class FROM manifest", "manifest")
def k01(spark, sf):
    root = folder(spark)
    sinks.pack(X.manifest(spark, sf).select("idx", "path", "class"), root, records_each=300)
    return spark.read.parquet(root)


@query("k03_export_resume", "SELECT idx, CASE WHEN idx % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM manifest", "manifest")
def k03(spark, sf):
    root = folder(spark)
    items = X.manifest(spark, sf).select("idx", "path", F.when(F.col("idx") % 5 == 0, "val").otherwise("train").alias("split"), F.col("class").alias("label"))
    sinks.export(items.where("idx % 2 = 0"), root)
    sinks.export(items, root)
    return spark.read.parquet(root).select("idx", "split")


@query("k04_statistics_cache", X.COV + " SELECT c.side, c.i::INT AS i, c.j::INT AS j, round(a.mean, 8) AS mean_i, round(g - a.mean * b.mean, 8) AS cov FROM c JOIN m a ON a.side = c.side AND a.i = c.i JOIN m b ON b.side = c.side AND b.i = c.j", "features")
def k04(spark, sf):
    root = folder(spark)
    f = X.features(spark, sf)
    G.cached_moments(f, root, {"set": "features"})
    again = G.cached_moments(f.limit(0), root, {"set": "features"})  # from the store, not from the rows
    return G.covariance(again).select("side", "i", "j", F.round("mean_i", 8).alias("mean_i"), F.round("cov", 8).alias("cov"))

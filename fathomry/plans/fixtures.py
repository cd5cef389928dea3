"""Tables that queries derive from the given ones: as DataFrames, and in SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("vec_id") % 2 == 0, "real").otherwise("gen")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), side.alias("side"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", F.col("label").alias("target"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: V.total(F.filter("x", lambda v, i: i % 10 == c))).alias("z"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("z", lambda v: v * 4)
    return logits(spark, sf_dir).select("id", F.col("id").alias("ord"), V.softmax(scaled).alias("p"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(W.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))).cast("long")
    n = F.get_json_object("props", "$.k").cast("long") + 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", step.alias("step"), F.concat(F.lit("Loss/"), "event_type").alias("name"), "value", n.alias("n"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("run").orderBy("step")
    nimg = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    t = telemetry(spark, sf_dir).withColumns({"nimg": nimg, "end_ts": F.col("ts"), "start_ts": F.coalesce(F.lag("ts").over(w), F.col("ts"))})
    return t.select("run", F.col("step").alias("tick"), "nimg", "start_ts", "end_ts")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PNG").otherwise(".jpg")))
    side = F.when(F.col("n_chars") % 7 == 0, 96).when(F.col("n_chars") % 5 == 0, 128).otherwise(64)
    return d.select(F.col("doc_id").alias("idx"), path.alias("path"), F.col("source").alias("class"), side.alias("width"), F.lit(64).alias("height"), F.when(F.col("n_chars") % 11 == 0, 1).otherwise(3).alias("channels"), F.col("n_chars").cast("long").alias("n_chars"))


def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.join(manifest(spark, sf_dir), labels.doc_id == F.col("idx")).select("path", F.col("quality").cast("int").alias("label"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.col("o_orderpriority"), F.lit("-run-"), (F.col("o_orderkey") % 50).cast("string"))
    top1 = F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.round(F.col("o_totalprice") / 1e6, 4))
    return o.select(
        F.col("o_orderkey").alias("id"),
        name.alias("name"),
        F.split("o_orderpriority", "[- ]+").alias("tags"),
        F.when(F.col("o_orderkey") % 9 == 0, "crashed").otherwise("finished").alias("state"),
        F.col("o_orderstatus").alias("dataset"),
        F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.concat(F.lit("net"), (F.col("o_custkey") % 4).cast("string"))).alias("backbone"),
        (F.col("o_custkey") % 300).cast("int").alias("epoch"),
        F.col("o_totalprice").alias("runtime_s"),
        top1.alias("lin_top1"),
        F.round(F.col("o_totalprice") / 2e6, 4).alias("knn_top1"),
        F.unix_timestamp("o_orderdate").cast("double").alias("created"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = features(spark, sf_dir).select(F.col("id").alias("image"), F.posexplode("x").alias("at", "v"))
    return p.select("image", F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).cast("int").alias("x"), "v")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("mask")
    p = pixels(spark, sf_dir).select("image", levels, "y", "x", "v").where(F.col("v") > F.col("mask") * 0.05)
    return p.select("image", "mask", "y", "x", (1.0 - F.col("mask") * 0.25).alias("score"))


#: The same tables in SQL; later ones may name earlier ones.
SQL = {
    "features": "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'gen' END AS side, label::INT AS label, embedding::DOUBLE[] AS x FROM embeddings",
    "logits": "SELECT id, label AS target, list_transform(range(0, 10), lambda c: list_sum(list_filter(x, lambda v, i: (i - 1) % 10 = c))) AS z FROM features",
    "probs": "SELECT id, id AS ord, list_transform(z, lambda v: exp(v * 4) / list_sum(list_transform(z, lambda w: exp(w * 4)))) AS p FROM logits",
    "telemetry": "SELECT user_id AS run, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, 'Loss/' || event_type AS name, value, json_extract(props, '$.k')::BIGINT + 1 AS n FROM events",
    "ticks": "SELECT run, step AS tick, (sum(n) OVER w)::BIGINT AS nimg, coalesce(lag(ts) OVER w, ts) AS start_ts, ts AS end_ts FROM telemetry WINDOW w AS (PARTITION BY run ORDER BY step)",
    "manifest": "SELECT doc_id AS idx, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PNG' ELSE '.jpg' END AS path, source AS class, CASE WHEN n_chars % 7 = 0 THEN 96 WHEN n_chars % 5 = 0 THEN 128 ELSE 64 END AS width, 64 AS height, CASE WHEN n_chars % 11 = 0 THEN 1 ELSE 3 END AS channels, n_chars::BIGINT AS n_chars FROM documents",
    "label_file": "SELECT path, quality::INT AS label FROM labels JOIN manifest ON doc_id = idx",
    "runs": "SELECT o_orderkey AS id, o_orderpriority || '-run-' || (o_orderkey % 50) AS name, string_split_regex(o_orderpriority, '[- ]+') AS tags, CASE WHEN o_orderkey % 9 = 0 THEN 'crashed' ELSE 'finished' END AS state, o_orderstatus AS dataset, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'net' || (o_custkey % 4) END AS backbone, (o_custkey % 300)::INT AS epoch, o_totalprice AS runtime_s, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE round(o_totalprice / 1e6, 4) END AS lin_top1, round(o_totalprice / 2e6, 4) AS knn_top1, epoch(o_orderdate)::DOUBLE AS created FROM orders",
    "pixels": "SELECT id AS image, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, x[i] AS v FROM features, unnest(generate_series(1, 64)) AS g(i)",
    "masks": "SELECT image, m::INT AS mask, y, x, 1.0 - m * 0.25 AS score FROM pixels, unnest([0, 1, 2]) AS g(m) WHERE v > m * 0.05",
}

#: After `features`: means (m) and second moments (c) of its columns.
COV = """, l AS (SELECT side, id, label, i - 1 AS i, x[i] AS v FROM features, unnest(generate_series(1, 64)) AS g(i)), m AS (SELECT side, i, avg(v) AS mean, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT a.side, a.i, b.i AS j, avg(a.v * b.v) AS g, covar_samp(a.v, b.v) AS s, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.id = b.id GROUP BY ALL)"""

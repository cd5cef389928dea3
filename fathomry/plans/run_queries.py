"""Queries over a registry of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from . import fixtures as X
from .registry import query


def nested(spark, sf):
    return X.runs(spark, sf).select("id", F.struct(F.col("dataset").alias("name"), F.struct("backbone", F.col("epoch").alias("n")).alias("model")).alias("data"))


@query("p01_flatten", "SELECT id, dataset AS data_name, backbone AS data_model_backbone, epoch AS data_model_n FROM runs", "runs")
def p01(spark, sf):
    return R.flattened(nested(spark, sf))


@query("p02_template", "SELECT id, dataset || '-' || state || '-e' || epoch AS title FROM runs", "runs")
def p02(spark, sf):
    return X.runs(spark, sf).select("id", R.filled("{dataset}-{state}-e{epoch}").alias("title"))


@query("p03_rename", "SELECT id AS run_id, lin_top1 AS linear FROM runs", "runs")
def p03(spark, sf):
    return X.runs(spark, sf).select("id", "lin_top1").withColumnsRenamed({"id": "run_id", "lin_top1": "linear"})


@query("p04_replace", "SELECT id, CASE dataset WHEN 'F' THEN 'flowers' WHEN 'O' THEN 'objects' ELSE dataset END AS dataset FROM runs", "runs")
def p04(spark, sf):
    return X.runs(spark, sf).select("id", R.replaced("dataset", {"F": "flowers", "O": "objects"}).alias("dataset"))


@query("p05_last_rule", "SELECT id, CASE WHEN contains(name, '-7') THEN 'seven' WHEN list_contains(tags, 'SPECIFIED') THEN 'other' WHEN contains(name, 'URGENT') THEN 'urgent' END AS algo FROM runs", "runs")
def p05(spark, sf):
    n = F.col("name")
    rules = [(n.contains("URGENT"), "urgent"), (F.array_contains("tags", "SPECIFIED"), "other"), (n.contains("-7"), "seven")]
    return X.runs(spark, sf).select("id", R.last_rule(rules).alias("algo"))


@query("p06_dictionary", "SELECT id, CASE backbone WHEN 'net0' THEN 11 WHEN 'net1' THEN 25 END AS params FROM runs", "runs")
def p06(spark, sf):
    return X.runs(spark, sf).select("id", R.mapped("backbone", {"net0": 11, "net1": 25}).alias("params"))


@query("p07_units", "SELECT id, round(runtime_s / 3600, 6) AS hours, round(lin_top1 * 100, 4) AS percent, make_timestamp((created * 1000000)::BIGINT) AS created_at FROM runs", "runs")
def p07(spark, sf):
    return X.runs(spark, sf).select("id", F.round(F.col("runtime_s") / 3600, 6).alias("hours"), F.round(F.col("lin_top1") * 100, 4).alias("percent"), F.timestamp_seconds("created").cast("timestamp_ntz").alias("created_at"))


@query("p08_tolerant_int", "SELECT id, TRY_CAST(CASE WHEN id % 4 = 0 THEN 'n/a' ELSE epoch::VARCHAR END AS INT) AS epoch FROM runs", "runs")
def p08(spark, sf):
    text = F.when(F.col("id") % 4 == 0, "n/a").otherwise(F.col("epoch").cast("string"))
    return X.runs(spark, sf).select("id", text.try_cast("int").alias("epoch"))


@query("p09_drop_empty", "SELECT * FROM runs", "runs")
def p09(spark, sf):
    return R.without_empty(X.runs(spark, sf).withColumn("unused", F.lit(None).cast("string")))


@query("p10_since", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def p10(spark, sf):
    return X.table(spark, sf, "orders").where("o_orderdate >= timestamp'1997-01-01'").select(F.col("o_orderkey").alias("id"))


@query("p11_filters", "SELECT id FROM runs WHERE (dataset = 'F' OR epoch > 250) AND backbone IN ('net1', 'net2') AND state NOT IN ('crashed')", "runs")
def p11(spark, sf):
    return X.runs(spark, sf).where(((F.col("dataset") == "F") | (F.col("epoch") > 250)) & F.col("backbone").isin("net1", "net2") & ~F.col("state").isin("crashed")).select("id")


@query("p12_tagged", "SELECT id FROM runs WHERE list_contains(tags, 'HIGH')", "runs")
def p12(spark, sf):
    return X.runs(spark, sf).where(F.array_contains("tags", "HIGH")).select("id")


@query("p13_substring", "SELECT id FROM runs WHERE contains(name, 'LOW-run-1')", "runs")
def p13(spark, sf):
    return X.runs(spark, sf).where(F.col("name").contains("LOW-run-1")).select("id")


@query("p17_nested_item", "SELECT id, backbone FROM runs", "runs")
def p17(spark, sf):
    text = nested(spark, sf).select("id", F.to_json("data").alias("data"))
    return text.select("id", F.get_json_object("data", "$.model.backbone").alias("backbone"))


@query("s11_registry", "SELECT id, 'dataset' AS key, dataset AS value FROM runs", "runs")
def s11(spark, sf):
    from ..sources.readers import run_registry

    lines = X.runs(spark, sf).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "name", "tags", "state", F.create_map(F.lit("dataset"), F.col("dataset"), F.lit("_private"), F.lit("x")).alias("config"), F.create_map(F.lit("top1"), F.col("knn_top1")).alias("summary"))).alias("value"))
    return run_registry(lines).select(F.col("id").cast("long").alias("id"), F.explode("config"))


@query("j04_reference", ", ref AS (SELECT dataset, backbone, state, avg(runtime_s) AS reference_s FROM runs WHERE epoch > 290 GROUP BY ALL) SELECT id, round(coalesce(reference_s, 1.0), 4) AS reference_s FROM runs LEFT JOIN ref USING (dataset, backbone, state)", "runs")
def j04(spark, sf):
    runs = X.runs(spark, sf)
    keys = ["dataset", "backbone", "state"]
    ref = R.subset_mean(runs, F.col("epoch") > 290, keys, "runtime_s").withColumnRenamed("mean", "reference_s")
    return R.with_reference(runs, ref, keys, "reference_s", 1.0).select("id", F.round("reference_s", 4).alias("reference_s"))


@query("w01_best_per_group", "SELECT id, dataset, backbone, lin_top1 FROM (SELECT *, row_number() OVER (PARTITION BY dataset, backbone ORDER BY lin_top1 DESC, id) AS k FROM runs WHERE lin_top1 IS NOT NULL AND backbone IS NOT NULL) WHERE k = 1", "runs")
def w01(spark, sf):
    return R.best_rows(X.runs(spark, sf), ["dataset", "backbone"], "lin_top1", "id").select("id", "dataset", "backbone", "lin_top1")


@query("w10_next_number", "SELECT coalesce(max(TRY_CAST(regexp_extract(name, '^(\\d+)', 1) AS BIGINT)), -1) + 1 AS next FROM runs", "runs")
def w10(spark, sf):
    return R.next_number(X.runs(spark, sf))


@query("w11_last_n", "SELECT id, backbone FROM (SELECT id, backbone, row_number() OVER (PARTITION BY backbone ORDER BY id DESC) AS k FROM runs) WHERE k <= 100", "runs")
def w11(spark, sf):
    return R.top_k(X.runs(spark, sf), ["backbone"], "id", "name", 100).select("id", "backbone")


@query("w14_cost", ", ref AS (SELECT dataset, avg(runtime_s) AS mean FROM runs WHERE state = 'finished' GROUP BY dataset) SELECT id, round(mean * epoch * 4 / 3600, 3) AS gpu_hours FROM runs JOIN ref USING (dataset)", "runs")
def w14(spark, sf):
    runs = X.runs(spark, sf)
    ref = R.subset_mean(runs, F.col("state") == "finished", ["dataset"], "runtime_s")
    timed = runs.join(ref, "dataset").withColumnsRenamed({"mean": "epoch_s", "epoch": "epochs"})
    return R.training_cost(timed, gpus=F.lit(4)).select("id", F.round("gpu_hours", 3).alias("gpu_hours"))


@query("a16_best_and_last", "SELECT backbone, dataset, max(knn_top1) AS best, arg_max(knn_top1, epoch::BIGINT * 10000000 + id) AS last FROM runs GROUP BY ALL", "runs")
def a16(spark, sf):
    return R.best_and_last(X.runs(spark, sf).withColumn("at", F.struct("epoch", "id")), ["backbone", "dataset"], "knn_top1", "at")


@query("a23_pivot", "SELECT backbone, tags[1] AS algo, max(lin_top1) FILTER (WHERE dataset = 'F') AS F, max(lin_top1) FILTER (WHERE dataset = 'O') AS O, max(lin_top1) FILTER (WHERE dataset = 'P') AS P FROM runs WHERE backbone IS NOT NULL GROUP BY ALL", "runs")
def a23(spark, sf):
    return R.pivoted_best(X.runs(spark, sf).withColumn("algo", F.get("tags", F.lit(0))), ["backbone", "algo"], "dataset", ["F", "O", "P"], "lin_top1")


@query("a24_subset_mean", "SELECT backbone, round(avg(runtime_s), 4) AS mean FROM runs WHERE dataset IN ('F', 'P') GROUP BY backbone", "runs")
def a24(spark, sf):
    return R.subset_mean(X.runs(spark, sf), F.col("dataset").isin("F", "P"), ["backbone"], "runtime_s").select("backbone", F.round("mean", 4).alias("mean"))


@query("a25_group_max", "SELECT backbone, epoch, max(lin_top1) AS lin_top1, max(knn_top1) AS knn_top1, max(name) AS name FROM runs WHERE backbone IS NOT NULL GROUP BY ALL", "runs")
def a25(spark, sf):
    return R.group_max(X.runs(spark, sf), ["backbone", "epoch"], ["lin_top1", "knn_top1", "name"])


@query("o01_by_score", "SELECT id, knn_top1 FROM runs ORDER BY knn_top1 DESC, id", "runs")
def o01(spark, sf):
    return X.runs(spark, sf).select("id", "knn_top1").orderBy(F.desc("knn_top1"), "id")


@query("o02_top_k", "SELECT id, dataset, place FROM (SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY knn_top1 DESC, id) AS place FROM runs) WHERE place <= 25", "runs")
def o02(spark, sf):
    return R.top_k(X.runs(spark, sf), ["dataset"], "knn_top1", "id", 25).select("id", "dataset", "place")


@query("o03_given_order", "SELECT id, backbone, list_position(['net2', 'net0', 'net3'], backbone) - 1 AS place FROM runs WHERE backbone IN ('net2', 'net0', 'net3')", "runs")
def o03(spark, sf):
    return R.in_order(X.runs(spark, sf), "backbone", ["net2", "net0", "net3"]).select("id", "backbone", "place")

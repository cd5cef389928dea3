"""Queries that run streams over telemetry and agree with the batch forms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as S
from . import fixtures as X
from .registry import query

SCHEMA = "run long, ts timestamp, step long, name string, value double, n long"


def folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{found.rstrip('/')}/streams-{uuid.uuid4().hex}"


#: Stretches of time that a stream reads, one to a trigger; rows of a file at most, about.
FILES, ROWS = 10, 200_000


def source(spark: SparkSession, sf: str, files: int = FILES, schema: str = SCHEMA) -> tuple[DataFrame, str]:
    """Telemetry as a folder of JSON lines and the stream that tails it: stretches of time written in order, each as equally many files, and one stretch to a trigger. schema: the columns that the stream reads (ts among them); no others are derived or written, so a stream that asks for no step does without the order of each run."""
    root = folder(spark)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = X.table(spark, sf, "events").select(t.alias("t")).agg(F.percentile_approx("t", [i / files for i in range(1, files)], 10_000)).first()[0]
    stretch = F.when(t.isNull(), -1).otherwise(sum(((t > c).cast("int") for c in cuts), F.lit(0)))
    rows = X.telemetry(spark, sf).select(*(c.split()[0] for c in schema.split(","))).withColumn("stretch", stretch).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.partitionBy("stretch").parquet(f"{root}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows").where("stretch >= 0")
    held = {r["stretch"]: r["count"] for r in rows.groupBy("stretch").count().collect()}
    parts = max(1, min(held.get(i, 0) for i in range(files)) // ROWS)
    for i in range(files):
        part = rows.where(F.col("stretch") == i).drop("stretch")
        (part.coalesce(1) if parts == 1 else part.repartition(parts)).write.mode("append").json(f"{root}/in")
    return S.tail(spark, f"{root}/in", schema, parts), root


def run(stream: DataFrame, root: str) -> DataFrame:
    return S.drained(stream, f"{root}/out", f"{root}/state")


@query("t01_windowed_moments", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, name, count(value) AS num, round(avg(value), 6) AS mean FROM telemetry GROUP BY ALL", "telemetry")
def t01(spark, sf):
    rows, root = source(spark, sf, schema="ts timestamp, name string, value double")
    last = X.telemetry(spark, sf).agg(F.max("ts").cast("timestamp") + F.expr("INTERVAL 3 DAYS")).first()[0]
    S.close_stream(spark, f"{root}/in", last)
    out = run(S.windowed_moments(rows, "1 day"), root)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "name", "num", F.round("mean", 6).alias("mean"))


_W = "WINDOW w AS (PARTITION BY run, name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("t02_smoothing", f"SELECT run, name, step, quantile_disc(value, 0.5) OVER w AS median, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most FROM telemetry {_W}", "telemetry")
def t02(spark, sf):
    rows, root = source(spark, sf)
    return run(S.smoothed(rows, ["run", "name"]), root).withColumn("mean", F.round("mean", 6))


@query("t03_records", ", b AS (SELECT run, name, step, value, min(value) OVER (PARTITION BY run, name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM telemetry) SELECT run, name, step, value AS best FROM b WHERE before IS NULL OR value < before", "telemetry")
def t03(spark, sf):
    rows, root = source(spark, sf)
    return run(S.records(rows, ["run", "name"]), root)


@query("t04_controller", ", l AS (SELECT run, name, list_prepend(0.0::DOUBLE, list(sign(value - 12)::DOUBLE ORDER BY step)) AS v FROM telemetry GROUP BY ALL) SELECT run, name, round(list_reduce(v, lambda p, s: greatest(0, least(1, p + s * 0.05))), 6) AS p FROM l", "telemetry")
def t04(spark, sf):
    rows, root = source(spark, sf)
    out = run(S.controlled(rows, ["run", "name"], target=12, gain=0.05), root)
    return out.groupBy("run", "name").agg(F.round(F.max_by("p", "step"), 6).alias("p"))


@query("t05_ema", ", l AS (SELECT run, name, list(value ORDER BY step) AS v FROM telemetry GROUP BY ALL) SELECT run, name, round(list_reduce(list_transform(v, lambda x, i: {'x': x, 'i': (i - 1)::DOUBLE}), lambda a, b: {'x': b.x + (a.x - b.x) * least(0.9, (b.i + 1) / (b.i + 10)), 'i': b.i}).x, 6) AS ema FROM l", "telemetry")
def t05(spark, sf):
    rows, root = source(spark, sf)
    return run(S.averaged(rows, ["run", "name"], 0.9), root).groupBy("run", "name").agg(F.round(F.max_by("ema", "step"), 6).alias("ema"))


@query("t06_last_n", "SELECT run, name, list(value ORDER BY step) AS bank FROM (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY step DESC) AS k FROM telemetry) WHERE k <= 5 GROUP BY ALL", "telemetry")
def t06(spark, sf):
    rows, root = source(spark, sf)
    return run(S.last_n(rows, ["run", "name"], 5), root).groupBy("run", "name").agg(F.max_by("bank", "step").alias("bank"))


@query("t07_tail", "SELECT run, step, name, value FROM telemetry", "telemetry")
def t07(spark, sf):
    rows, root = source(spark, sf)
    return run(rows.select("run", "step", "name", "value"), root)


@query("t08_alerts", "SELECT run, step FROM telemetry WHERE n % 10 = 0", "telemetry")
def t08(spark, sf):
    rows, root = source(spark, sf)
    bad = rows.withColumn("value", F.when(F.col("n") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return run(S.alerting(bad).select("run", "step"), root)


@query("t09_resume", ", l AS (SELECT run, name, list(value ORDER BY step) AS v FROM telemetry GROUP BY ALL) SELECT run, name, len(v) AS n, round(list_reduce(list_transform(v, lambda x, i: {'x': x, 'i': (i - 1)::DOUBLE}), lambda a, b: {'x': b.x + (a.x - b.x) * least(0.9, (b.i + 1) / (b.i + 10)), 'i': b.i}).x, 6) AS ema FROM l", "telemetry")
def t09(spark, sf):
    rows, root = source(spark, sf)
    averages = S.averaged(rows, ["run", "name"], 0.9)
    done = S.run_some(averages, f"{root}/out", f"{root}/state", FILES // 2)
    if not 0 < done < FILES:
        raise ValueError("the stream was to stop half way")
    return run(averages, root).groupBy("run", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.max_by("ema", "step"), 6).alias("ema"))

"""Sinks (S6, K1, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration
from ..operators.manifest import not_done


def pack(items: DataFrame, path: str, *, records_each: int = 100_000) -> None:
    """Packed dataset: few Parquet files of bounded length instead of many small files (K1)."""
    items.write.option("maxRecordsPerFile", records_each).parquet(path)


def export(items: DataFrame, path: str, key: str = "idx") -> int:
    """Writes the items that are not there yet under split=/label= folders; returns how many (K3)."""
    spark = items.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # nothing exported yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = items.select(key).limit(0)
    todo = not_done(items, done, key)
    n = todo.count()
    if n:
        todo.write.mode("append").partitionBy("split", "label").parquet(path)
    return n


def append_metrics(results: DataFrame, path: str, *, metric: str, seconds: float, snapshot: str | None = None) -> None:
    """Adds a line for each row of numbers, as metric logs have them."""
    fields = F.create_map(*[x for c in results.columns for x in (F.lit(c), F.col(c).cast("double"))])
    line = F.struct(fields.alias("results"), F.lit(metric).alias("metric"), F.lit(float(seconds)).alias("total_time"), duration(F.lit(seconds)).alias("total_time_str"), F.lit(snapshot).cast("string").alias("snapshot_pkl"), F.unix_micros(F.current_timestamp()).cast("double").alias("timestamp"))
    results.select(line.alias("l")).select("l.*").write.mode("append").json(path)

"""Training telemetry in batch: moments, smoothing, rates, records, folds in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import CHUNK, beside, chunks, clip_map, ema_map, joined, long_series


def finite(x: str) -> Column:
    """x, with NaN as null."""
    return F.when(~F.isnan(x), F.col(x))


def micros(x: str | Column) -> Column:
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))


def moments(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, num, mean, std: population deviation, held at 0; 0 for one value, null for none (A9). Nulls and NaN do not count."""
    v = finite(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("num"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / F.col("num")
    return out.select(*keys, "num", mean.alias("mean"), F.when(F.col("num") > 0, F.sqrt(F.greatest(F.col("q") / F.col("num") - mean * mean, F.lit(0.0)))).alias("std"))


def meter(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the weighted mean, least, largest and last value."""
    return df.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", "step").alias("last"))


def rates(ticks: DataFrame) -> DataFrame:
    """Seconds a tick, seconds a thousand images, and seconds between ticks (W2). The first tick of a run has no images before it."""
    w = W.partitionBy("run").orderBy("tick")
    start, end = (micros(c) / 1e6 for c in ("start_ts", "end_ts"))
    took = end - start
    return ticks.select("run", "tick", took.alias("sec_per_tick"), (took / (F.col("nimg") - F.coalesce(F.lag("nimg").over(w), F.lit(0))) * 1000).alias("sec_per_kimg"), (start - F.lag(end).over(w)).alias("maintenance"))


def running_best(df: DataFrame, keys: list[str], order: str = "step", value: str = "value", *, size: int = CHUNK) -> DataFrame:
    """df with best (the least so far) and is_new, true where the value is strictly less than all before (W3). A series of more than `size` rows is many tasks."""
    long = long_series(df, keys, order, size)
    w = W.partitionBy(*keys, *(["__chunk"] if long is not None else [])).orderBy(order)
    before = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    if long is not None:
        df = beside(long, keys, {"__m": F.min(value)}, {"__least": F.min("__m")})
        before = F.least(before, "__least")
    return df.withColumn("is_new", F.coalesce(F.col(value) < before, F.lit(True))).withColumn("best", F.least(F.col(value), before)).drop("__chunk", "__least")


def smoothed(df: DataFrame, keys: list[str], order: str = "step", value: str = "value", size: int = 20, *, chunk: int = CHUNK) -> DataFrame:
    """df with lower median, mean, largest and last of the last `size` rows (W4). Of a series of more than `chunk` rows, stretches of that many by rank are a task each, with the size - 1 rows before them."""
    chunk = max(chunk, size)
    long = long_series(df, keys, order, chunk)
    over = list(keys)
    if long is not None:
        ranked = beside(long, keys, {"__n": F.count(F.lit(1))}, {"__first": F.sum("__n")})
        rank = F.coalesce("__first", F.lit(0)) + F.row_number().over(W.partitionBy(*keys, "__chunk").orderBy(order)) - 1
        block = F.floor(F.col("__rank") / chunk)
        into = F.when(F.col("__rank") % chunk > chunk - size, F.array(block, block + 1)).otherwise(F.array(block))
        df = ranked.withColumn("__rank", rank).withColumn("__block", F.explode(into)).drop("__chunk", "__first")
        over.append("__block")
    w = W.partitionBy(*over).orderBy(order).rowsBetween(1 - size, 0)
    near = F.array_sort(F.collect_list(value).over(w))
    df = df.withColumn("__near", near)
    median = F.get("__near", F.floor((F.size("__near") - 1) / 2).cast("int"))
    df = df.withColumns({"median": median, "mean": F.avg(value).over(w), "most": F.max(value).over(w), "last": F.col(value)}).drop("__near")
    if long is not None:
        df = df.where(F.floor(F.col("__rank") / chunk) == F.col("__block")).drop("__rank", "__block")
    return df


def cumulative_mean(df: DataFrame, keys: list[str], order: str = "step", value: str = "value", *, size: int = CHUNK) -> DataFrame:
    """df with the mean so far (W5). A series of more than `size` rows is many tasks."""
    long = long_series(df, keys, order, size)
    w = W.partitionBy(*keys, *(["__chunk"] if long is not None else [])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    s, n = F.sum(value).over(w), F.count(value).over(w)
    if long is not None:
        df = beside(long, keys, {"__s": F.sum(value), "__c": F.count(value)}, {"__sum": F.sum("__s"), "__count": F.sum("__c")})
        s, n = (F.when(F.col(b).isNull(), x).otherwise(F.coalesce(x, F.lit(0)) + F.col(b)) for x, b in ((s, "__sum"), (n, "__count")))
    return df.withColumn("mean_so_far", s / n).drop("__chunk", "__sum", "__count")


def ema(df: DataFrame, keys: list[str], decay: float, order: str = "step", value: str = "value", *, size: int = CHUNK) -> DataFrame:
    """keys, n, ema: an average with the warm-up decay min(decay, (1 + i) / (10 + i)), from the first value on (W6). Null values do not count."""
    made = chunks(df, keys, order, value, size=size)
    maps = made.select(*keys, "chunk", F.size("values").alias("n"), ema_map("values", "first", decay).alias("m"))
    return joined(maps, keys, F.lit(0.0), lambda x, m: m["a"] * x + m["b"]).withColumnRenamed("x", "ema")


def controller(df: DataFrame, keys: list[str], *, target: float, gain: float, order: str = "step", value: str = "value", size: int = CHUNK) -> DataFrame:
    """keys, p: an integrator that moves by gain towards the side of the target, held in 0 to 1 after each step (W7). Null values do not count."""
    made = chunks(df, keys, order, value, size=size)
    maps = made.select(*keys, "chunk", F.size("values").alias("n"), clip_map("values", lambda v: F.signum(v - target) * gain, 0.0, 1.0).alias("m"))
    return joined(maps, keys, F.lit(0.0), lambda p, m: F.greatest(m["lo"], F.least(m["hi"], p + m["s"]))).select(*keys, F.col("x").alias("p"))


def interval_moments(df: DataFrame, run: str, name: str, tick: Column) -> DataFrame:
    """run, name, tick, num, mean: moments of each tick; a tick without values keeps the last mean."""
    df = df.withColumn("tick", tick)
    got = df.groupBy(run, name, "tick").agg(F.count("value").alias("num"), F.avg("value").alias("mean"))
    span = df.groupBy(run).agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    grid = df.select(run, name).distinct().join(span, run).select(run, name, F.explode(F.sequence("a", "b")).alias("tick"))
    w = W.partitionBy(run, name).orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    out = grid.join(got, [run, name, "tick"], "left")
    return out.select(run, name, "tick", F.coalesce("num", F.lit(0)).alias("num"), F.last("mean", ignorenulls=True).over(w).alias("mean"))


def time_left(ticks: DataFrame) -> DataFrame:
    """run, tick, left: mean seconds a tick so far times the ticks to come."""
    w = W.partitionBy("run").orderBy("tick")
    took = (micros("end_ts") - micros("start_ts")) / 1e6
    mean = F.avg(took).over(w.rowsBetween(W.unboundedPreceding, 0))
    return ticks.select("run", "tick", (mean * (F.count(F.lit(1)).over(W.partitionBy("run")) - F.col("tick"))).alias("left"))


def named(df: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Rows whose whole name fits the pattern."""
    return df.where(F.col(name).rlike(f"^(?:{pattern})$"))


def per_class(metrics: DataFrame, results: str = "results") -> DataFrame:
    """metric, class, value from a map with keys like `<metric>_class_<k>`."""
    rows = metrics.select("*", F.explode(results).alias("key", "value"))
    rows = rows.where(F.col("key").rlike(r"_class_\d+$"))
    return rows.withColumns({"metric": F.regexp_extract("key", r"^(.*)_class_\d+$", 1), "class": F.regexp_extract("key", r"_class_(\d+)$", 1).cast("int")}).drop(results, "key")


def alerts(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is NaN or infinite (P19). Works on a stream as well."""
    return df.where(F.isnan(value) | (F.abs(F.col(value)) == float("inf")))


def scalar_events(df: DataFrame, prefix: str = "Metrics/") -> DataFrame:
    """tag, step (thousands of images) and seconds since the run began (K5)."""
    start = F.min("ts").over(W.partitionBy("run"))
    return df.select("run", F.concat(F.lit(prefix), "name").alias("tag"), F.floor(F.col("nimg") / 1000).cast("long").alias("step"), "value", ((micros("ts") - micros(start)) / 1e6).alias("walltime"))

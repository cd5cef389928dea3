"""Structured Streaming forms of the telemetry operators (T1 to T9). Each agrees with its batch form on the same rows.

Event time is the record's timestamp; rows later than the watermark are dropped, never folded again. Order inside a trigger is
(ts, step) for each key; across triggers it is arrival. Folds keep a small state for each key in the state store, many keys to a
row of it (`BUCKETS`; a checkpoint folder holds for that number only), and take a key's rows of one trigger as three arrays, folded
by prefixes and sliding windows rather than row by row; how much a trigger reads is a parameter of `tail`. Resuming (T9) is the
query's checkpoint folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import affine_prefixes, clip_prefixes
from ..operators.telemetry import alerts, finite

LATE = "10 minutes"


def tail(spark: SparkSession, path: str, schema: str, files_each: int = 1) -> DataFrame:
    """Rows of JSON-line files as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(path)


def windowed_moments(rows: DataFrame, every: str, *, late: str = LATE) -> DataFrame:
    """start, name, num, mean, std of each window of event time (T1). The mark of close_stream() lets the last windows out and is itself left out."""
    v = finite("value")
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "name").agg(F.count(v).alias("num"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count("name").alias("named"))
    mean = F.col("s") / F.col("num")
    std = F.when(F.col("num") > 0, F.sqrt(F.greatest(F.col("q") / F.col("num") - mean * mean, F.lit(0.0))))
    out = out.where("named > 0")  # not by name, which the optimizer would move below the watermark
    return out.select(F.col("w.start").alias("start"), "name", "num", mean.alias("mean"), std.alias("std"))


def close_stream(spark: SparkSession, path: str, at: Any) -> None:
    """Ends a folder that is tailed: two records with nothing but a timestamp, later than all windows. The first moves the watermark past them, the second makes the trigger that lets them out."""
    for _ in range(2):
        spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").json(path)


Fold = Callable[[Any, np.ndarray, np.ndarray], tuple[Any, dict[str, Any]]]


#: Parts of the keys; a stream's state is one row for each, so a trigger costs calls to the state store for parts, not for keys.
BUCKETS = 256


class _Series(StatefulProcessor):
    """Folds the rows of the keys of a bucket, trigger by trigger. The bucket's state is one Arrow table of small states: keys, and the fields of `state`, lists of them where `listed`."""

    def __init__(self, keys: list[T.StructField], state: str, listed: bool, start: tuple, fold: Fold) -> None:
        self.keys, self.listed, self.start, self.fold = keys, listed, start, fold
        self.fields = [T.StructField(f.name, T.ArrayType(f.dataType) if listed else f.dataType) for f in T.StructType.fromDDL(state)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "states binary")
        self.schema = to_arrow_schema(T.StructType([T.StructField(f"k{i}", k.dataType) for i, k in enumerate(self.keys)] + [T.StructField(f"s{i}", f.dataType) for i, f in enumerate(self.fields)]))

    def _held(self) -> dict[tuple, Any]:
        if not self.state.exists():
            return {}
        table = pa.ipc.open_stream(self.state.get()[0]).read_all()
        columns = [c.to_pylist() for c in table.columns]
        n = len(self.keys)
        states = (np.array(x, float) for x in columns[n]) if self.listed else zip(*columns[n:])
        return dict(zip(zip(*columns[:n]), states))

    def _keep(self, held: dict[tuple, Any]) -> None:
        states = [[x.tolist() for x in held.values()]] if self.listed else list(zip(*held.values()))
        table = pa.table([pa.array(list(x), f.type) for x, f in zip([*zip(*held), *states], self.schema)], schema=self.schema)
        data = pa.BufferOutputStream()
        with pa.ipc.new_stream(data, self.schema) as out:
            out.write_table(table)
        self.state.update((data.getvalue().to_pybytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        named = []
        for i in range(len(self.keys)):
            column = every[f"key{i}"].astype(object)
            named.append(column.where(~every[f"null{i}"], None).tolist())
        codes: dict[tuple, int] = {}
        code = np.array([codes.setdefault(k, len(codes)) for k in zip(*named)])
        ts, step, value = (every[c].to_numpy() for c in ("ts", "step", "value"))
        order = np.lexsort((step, ts, code))
        step, value = step[order], value[order].astype(float)
        ends = np.cumsum(np.bincount(code)).tolist()
        held, made = self._held(), []
        for k, a, b in zip(codes, [0, *ends], ends):
            before = held.get(k)
            held[k], out = self.fold((np.zeros(0) if self.listed else self.start) if before is None else before, step[a:b], value[a:b])
            made.append(out)
        self._keep(held)
        sizes = [len(out["step"]) for out in made]
        found = {f.name: pd.Series([k[i] for k, n in zip(codes, sizes) for _ in range(n)], dtype=object) for i, f in enumerate(self.keys)}
        for c in made[0]:
            found[c] = [x for out in made for x in out[c]] if isinstance(made[0][c], list) else np.concatenate([out[c] for out in made])
        if sum(sizes):
            yield pd.DataFrame(found)

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, keys: list[str], out: str, fold: Fold, *, state: str, start: tuple = (), listed: bool = False) -> DataFrame:
    """keys and what fold returns for the rows of a trigger in order, given the key's state."""
    named = [rows.schema[k] for k in keys]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named)
    # numbers that may be null would come to pandas as doubles
    whole = [F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) if isinstance(f.dataType, T.IntegralType) else F.col(f.name) for f in named]
    told = [x for i, (f, v) in enumerate(zip(named, whole)) for x in (v.alias(f"key{i}"), F.col(f.name).isNull().alias(f"null{i}"))]
    wanted = rows.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket"), *told, "ts", "step", "value")
    return wanted.groupBy("bucket").transformWithStateInPandas(_Series(named, state, listed, start, fold), f"{kinds}, {out}", "Append", "None")


def _windows(near: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last `size` values up to each, behind values that come before; how many of them there are; and the last size - 1 of all."""
    every = np.r_[near, values]
    padded = np.r_[np.full(size - 1, np.nan), every]
    seen = np.minimum(size, len(near) + 1 + np.arange(len(values)))
    return np.lib.stride_tricks.sliding_window_view(padded, size)[len(near) :], seen, every


def smoothed(rows: DataFrame, keys: list[str], size: int = 20) -> DataFrame:
    """keys, step, median (lower), mean, most of the last `size` values."""

    def fold(near: np.ndarray, step: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, dict]:
        windows, seen, every = _windows(near, value, size)
        median, mean, most = (np.empty(len(value)) for _ in range(3))
        for a in range(0, len(value), 50_000):
            w, n = windows[a : a + 50_000], seen[a : a + 50_000]
            there = np.arange(size) >= size - n[:, None]
            ordered = np.sort(np.where(there, w, np.inf), axis=1)
            at = np.arange(len(n))
            median[a : a + len(n)], most[a : a + len(n)] = ordered[at, (n - 1) // 2], ordered[at, n - 1]
            mean[a : a + len(n)] = np.where(there, w, 0.0).sum(axis=1) / n
        return every[max(0, len(every) - size + 1) :], {"step": step, "median": median, "mean": mean, "most": most}

    return _folded(rows, keys, "step long, median double, mean double, most double", fold, state="x double", listed=True)


def records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, best: rows strictly below all before."""

    def fold(held: tuple, step: np.ndarray, value: np.ndarray) -> tuple[tuple, dict]:
        best = np.fmin.accumulate(np.r_[np.nan if held[0] is None else held[0], value])
        new = (value < best[:-1]) | np.isnan(best[:-1])
        return (float(best[-1]),), {"step": step[new], "best": value[new]}

    return _folded(rows, keys, "step long, best double", fold, state="best double", start=(None,))


def controlled(rows: DataFrame, keys: list[str], *, target: float, gain: float) -> DataFrame:
    """keys, step, p: the integrator after each row (T4)."""

    def fold(held: tuple, step: np.ndarray, value: np.ndarray) -> tuple[tuple, dict]:
        s, low, high = clip_prefixes(gain * np.sign(value - target), 0.0, 1.0)
        p = np.clip(held[0] + s, low, high)
        return (float(p[-1]),), {"step": step, "p": p}

    return _folded(rows, keys, "step long, p double", fold, state="p double", start=(0.0,))


def averaged(rows: DataFrame, keys: list[str], decay: float) -> DataFrame:
    """keys, step, ema after each row, with the warm-up of the batch form (T5)."""

    def fold(held: tuple, step: np.ndarray, value: np.ndarray) -> tuple[tuple, dict]:
        n, x = held
        i = n + np.arange(len(value))
        d = np.where(i == 0, 0.0, np.minimum(decay, (1 + i) / (10 + i)))
        a, b = affine_prefixes(d, (1 - d) * value)
        out = a * x + b
        return (n + len(value), float(out[-1])), {"step": step, "ema": out}

    return _folded(rows, keys, "step long, ema double", fold, state="n long, x double", start=(0, 0.0))


def last_n(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, step, bank: the last n values after each row, oldest first."""

    def fold(near: np.ndarray, step: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, dict]:
        windows, seen, every = _windows(near, value, n)
        return every[max(0, len(every) - n + 1) :], {"step": step, "bank": [w[n - k :].tolist() for w, k in zip(windows, seen.tolist())]}

    return _folded(rows, keys, "step long, bank array<double>", fold, state="x double", listed=True)


def alerting(rows: DataFrame) -> DataFrame:
    """Rows whose value is NaN or infinite."""
    return alerts(rows)


#: The state store that folds need.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = "spark.sql.shuffle.partitions"


def _started(stream: DataFrame, sink: str, checkpoint: str, mode: str, **trigger: Any):
    """The query, started with the state store that folds need and no more parts of it than cores, since each part is opened and committed in each trigger; the session's own settings are put back."""
    spark = stream.sparkSession
    conf = spark.conf
    before = {k: conf.get(k) for k in (_STORE, _PARTS)}
    conf.set(_STORE, _ROCKS)
    conf.set(_PARTS, str(min(int(before[_PARTS]), spark.sparkContext.defaultParallelism)))
    try:
        return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**trigger).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def drained(stream: DataFrame, sink: str, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """What a stream makes of all there is so far, as a table of files; run again with the same folders, it goes on where it stopped."""
    _started(stream, sink, checkpoint, mode, availableNow=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def run_some(stream: DataFrame, sink: str, checkpoint: str, triggers: int, *, mode: str = "append") -> int:
    """Runs a stream until so many triggers are done, then stops it between two; returns how many were done."""
    query = _started(stream, sink, checkpoint, mode, processingTime="0 seconds")
    try:
        while query.isActive and (not query.lastProgress or query.lastProgress["batchId"] + 1 < triggers):
            time.sleep(0.05)
        if (failed := query.exception()) is not None:
            raise failed
    finally:
        query.stop()
    return query.lastProgress["batchId"] + 1

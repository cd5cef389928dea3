"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; words are the maximal runs of anything else.
SPACES = b" \t\n\r\x0b\x0c"
#: Bytes of an Arrow batch inside small_batches(), and the setting that holds them.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset on a local master, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _temporary()
    return found.rstrip("/")


@cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


class _Open(threading.local):
    """Of each scratch() that is open in this thread, the tables written in it."""

    def __init__(self) -> None:
        self.tables: list[list[tuple[SparkSession, str]]] = []


_OPEN = _Open()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that kept() names: nothing that is returned may read the others. A store that Spark writes to is reached as Spark does."""
    _OPEN.tables.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.tables.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand Python batches of about BATCH bytes, unless the session sets its own limit: batches of a number of rows hold as much as their texts are long, in the JVM's buffers and again in Python."""
    free = spark.conf.get(BATCH_BYTES, None) is None
    if free:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        if free:
            spark.conf.unset(BATCH_BYTES)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as by written(), to outlive scratch()."""
    out = written(df, name)
    if _OPEN.tables:
        _OPEN.tables[-1].pop()
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.tables:
        _OPEN.tables[-1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to add (compared as Spark does, without case)."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def append(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], text: str | None = None) -> DataFrame:
    """df with columns computed batch by batch. make() runs once in each task and returns batch -> arrays; columns of the same names are replaced. text: a column by whose bytes batches are cut, so that a task holds little at once."""
    df = without(df, *[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist() if text else []
            for a, b in pieces(sizes) if text else [(0, batch.num_rows)]:
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *f(part)], names=schema.names)

    return df.mapInArrow(run, schema)


def raw(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_string(array.type):
        array = array.view(pa.binary())
    elif pa.types.is_large_string(array.type):
        array = array.view(pa.large_binary())
    return [x or b"" for x in array.to_pylist()]


def pieces(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each, so that scratch arrays stay small."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def sizes_of(texts: pa.Array) -> list[int]:
    """Bytes of each text; null counts as empty."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()

"""Readers for the files around training runs (S1 to S11). All of them are Spark's own readers with a shape on top."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import basename, extension, public_keys
from ..operators.manifest import class_index

#: Suffixes of image files.
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".gif", ".tif", ".tiff", ".ppm")
STATS = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.DoubleType()) for n in ("num", "mean", "std")]))
METRIC = "results map<string,double>, metric string, total_time double, total_time_str string, num_gpus int, snapshot_pkl string, timestamp double"
RUN = "id string, name string, tags array<string>, state string, config map<string,string>, summary map<string,double>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, length of all files below a folder; contents are not read unless asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, class (the folder below the root) and the class's index."""
    found = files(spark, root).select("path", F.element_at(F.split("path", "/"), -2).alias("class"))
    return found.join(class_index(found), "class").select("path", "class", F.col("index").alias("label"))


def images(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Paths of images in order, the first `limit` of them."""
    return image_paths(files(spark, root), limit)


def image_paths(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """The same of a listing that has been made already, such as an archive's."""
    out = listing.select("path").where(extension(F.col("path")).isin(*IMAGES)).orderBy("path")
    return out.limit(limit) if limit is not None else out


def label_file(spark: SparkSession, path: str, *, one_document: bool = True) -> DataFrame:
    """path, label from `{"labels": [[path, label], ...]}`; empty if labels are null or absent (S3). one_document: a file is one record, as the format has it; else each line is."""
    read = spark.read.schema("labels array<array<string>>").option("multiLine", one_document).json(path)
    return read.select(F.explode("labels").alias("l")).select(F.get("l", F.lit(0)).alias("path"), F.get("l", F.lit(1)).cast("int").alias("label"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """name, class and box from a file with tabs."""
    return spark.read.csv(path, sep="\t", schema="name string, class string, x0 int, y0 int, x1 int, y1 int")


def subset_list(spark: SparkSession, path: str) -> DataFrame:
    """name, class (what stands before the first `_`)."""
    return spark.read.text(path).where(F.col("value") != "").select(F.col("value").alias("name"), F.substring_index("value", "_", 1).alias("class"))


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Metric records, one in each line."""
    return spark.read.schema(METRIC).json(path)


def parse_tick_stats(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of `name -> {num, mean, std}` as rows (S7). Entries that are no such record, as a timestamp, are left out."""
    names = F.explode(F.json_object_keys(value)).alias("name")
    rows = lines.select("*", names)
    stats = F.from_json(value, T.MapType(T.StringType(), T.StringType()))
    one = F.from_json(F.try_element_at(stats, F.col("name")), STATS.valueType)
    return rows.withColumn("__s", one).where(F.col("__s.num").isNotNull()).select(*[c for c in lines.columns if c != value], "name", "__s.*")


def tick_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_tick_stats(spark.read.text(path))


def iteration_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with a header; rows with too few or too many fields keep what fits and show up in _corrupt."""
    return spark.read.csv(path, header=True, schema=schema + ", _corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)


def representations(spark: SparkSession, path: str) -> DataFrame:
    """row, x from .npz files: the array `reps`, else `embeddings`, else the only one; [N, D, 1, 1] counts as [N, D]."""
    return unpacked_representations(spark.read.format("binaryFile").load(path))


def unpacked_representations(contents: DataFrame) -> DataFrame:
    """The same of the files' contents, as (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content)) as data:
                    key = next((k for k in ("reps", "embeddings") if k in data.files), data.files[0] if len(data.files) == 1 else None)
                    if key is None:
                        raise ValueError(f"{name}: which array? {data.files}")
                    x = data[key]
                x = x.reshape(x.shape[:2]) if x.ndim == 4 and x.shape[2:] == (1, 1) else x
                if x.ndim != 2:
                    raise ValueError(f"{name}: two dimensions are needed, not {x.ndim}")
                for a in range(0, len(x), 4096):
                    yield pd.DataFrame({"path": name, "row": np.arange(a, min(a + 4096, len(x))), "x": list(x[a : a + 4096].astype(np.float32))})

    return contents.select("path", "content").mapInPandas(run, "path string, row long, x array<float>")


def with_normal_vectors(items: DataFrame, key: str, dim: int, seed: int = 0) -> DataFrame:
    """key, x: a standard normal vector for each row: two parts of a hash of the seed, its key and the dimension, as a length and an angle, so that partitions do not matter."""

    def normal(d: Column) -> Column:
        h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), d.cast("string")))
        u, v = (F.conv(F.substring(h, a, 8), 16, 10).cast("double") / float(1 << 32) for a in (1, 9))
        return (F.sqrt(-2 * F.log(u + 2.0**-32)) * F.cos(2 * np.pi * v)).cast("float")

    return items.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal).alias("x"))


def synthetic_representations(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """id, x: n such vectors."""
    return with_normal_vectors(spark.range(n), "id", dim, seed)


def run_registry(lines: DataFrame, value: str = "value") -> DataFrame:
    """Exported runs, one in each line, less the configuration keys that start with `_`."""
    return lines.select(F.from_json(value, RUN).alias("r")).select("r.*").withColumn("config", public_keys(F.col("config")))


def name_of(path: str = "path"):
    return basename(F.col(path))

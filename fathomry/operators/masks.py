"""Masks, patches and pixels in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pixel_stats(pixels: DataFrame) -> DataFrame:
    """One row: mean and deviation over all pixels (A10), through one row for each image."""
    per = pixels.groupBy("image").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    mean = F.sum("s") / F.sum("n")
    return per.agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"))


def image_stats(pixels: DataFrame) -> DataFrame:
    """One row: mean over images of their means and deviations."""
    per = pixels.groupBy("image").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    return per.agg(F.avg("m").alias("mean"), F.avg("d").alias("std"))


def masked_psnr(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, psnr in dB for values in [-1, 1] where mask is set (A20). pairs: a, b, mask."""
    error = F.sum((F.col("a") - F.col("b")) ** 2 * F.col("mask")) / F.sum("mask")
    return pairs.groupBy(*keys).agg((20 * np.log10(2) - 10 * F.log10(error)).alias("psnr"))


def spectrum_window(size: int, beta: float) -> np.ndarray:
    """A Kaiser window of unit energy in each direction, so its squares add up to 1."""
    row = np.kaiser(size, beta)
    row /= np.sqrt(np.sum(row**2))
    return np.outer(row, row)


def power_spectrum(images: DataFrame, size: int, *, mean: float, std: float, beta: float = 8.0, interpolation: int = 1) -> DataFrame:
    """ky, kx, power: mean squared modulus of the whitened, Kaiser-windowed, padded images (A21). images: v, an array of size * size. Tasks add up before anything is shuffled."""
    full = size * interpolation
    window = spectrum_window(size, beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((full, full))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
            padded = np.zeros((len(x), full, full))
            padded[:, :size, :size] = (x - mean) / std * window
            total += np.square(np.abs(np.fft.fftn(padded, axes=(1, 2)))).sum(axis=0)
            n += len(x)
        if n:
            ky, kx = np.divmod(np.arange(full * full, dtype=np.int32), np.int32(full))
            yield pa.RecordBatch.from_arrays([pa.array(ky), pa.array(kx), pa.array(total.ravel()), pa.array(np.full(full * full, n))], names=["ky", "kx", "s", "n"])

    return images.select("v").mapInArrow(run, "ky int, kx int, s double, n long").groupBy("ky", "kx").agg((F.sum("s") / F.sum("n")).alias("power"))


def radial_profile(grid: DataFrame, size: int, y: str = "y", x: str = "x", v: str = "v") -> DataFrame:
    """radius, mean: means over whole radii from the centre."""
    c = size // 2
    r = F.floor(F.sqrt((F.col(y) - c) * (F.col(y) - c) + (F.col(x) - c) * (F.col(x) - c))).cast("int")
    return grid.groupBy(r.alias("radius")).agg(F.avg(v).alias("mean"))


def pooled(positions: DataFrame, key: str, x: str = "x", mask: str | None = None) -> DataFrame:
    """key, x: mean vector over positions, all of them or the masked ones, with 1e-6 added to their number."""
    w = F.col(mask).cast("double") if mask else F.lit(1.0)
    long = positions.select(key, w.alias("w"), F.posexplode(x).alias("d", "v"))
    means = long.groupBy(key, "d").agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + (1e-6 if mask else 0.0))).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias(x))


def mask_stats(masks: DataFrame) -> DataFrame:
    """image, mask, area, centroid, box and share of the box that is filled."""
    out = masks.groupBy("image", "mask").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("bottom"), F.max("x").alias("right"))
    return out.withColumn("fill", F.col("area") / ((F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)))


def overlaps(masks: DataFrame) -> DataFrame:
    """image, a, b, both: pixels shared by two masks of one image, a < b (J11). Joined on the pixel, so only masks that meet are paired."""
    left = masks.select("image", F.col("mask").alias("a"), "y", "x")
    right = masks.select("image", F.col("mask").alias("b"), "y", "x")
    return left.join(right, ["image", "y", "x"]).where("a < b").groupBy("image", "a", "b").agg(F.count(F.lit(1)).alias("both"))


def ious(masks: DataFrame) -> DataFrame:
    """image, a, b, iou: intersection over union, for masks that meet (M4, U4)."""
    area = masks.groupBy("image", "mask").agg(F.count(F.lit(1)).alias("area"))
    a, b = (area.select("image", F.col("mask").alias(n), F.col("area").alias(f"area_{n}")) for n in "ab")
    return overlaps(masks).join(a, ["image", "a"]).join(b, ["image", "b"]).select("image", "a", "b", (F.col("both") / F.greatest(F.lit(1), F.col("area_a") + F.col("area_b") - F.col("both"))).alias("iou"))


def scored(masks: DataFrame) -> DataFrame:
    """masks with score: predicted IoU times stability (M1)."""
    return masks.withColumn("score", F.col("predicted_iou") * F.col("stability"))


def deduplicated(masks: DataFrame, *, most_iou: float = 0.9, keep: int = 250) -> DataFrame:
    """image, mask, score of the masks kept in order of score, less those too like one kept already (M2). Serial in an image, which has a bounded number of masks; images are dealt over tasks."""
    best = masks.groupBy("image", "mask").agg(F.max("score").alias("score"))
    alike = ious(masks).where(F.col("iou") >= most_iou)
    near = alike.select("image", F.col("a").alias("mask"), F.col("b").alias("other")).union(alike.select("image", F.col("b").alias("mask"), F.col("a").alias("other")))
    with_near = best.join(near.groupBy("image", "mask").agg(F.collect_list("other").alias("near")), ["image", "mask"], "left")
    order = F.struct((-F.col("score")).alias("s"), "mask", "score", F.coalesce("near", F.array().cast("array<int>")).alias("near"))
    kind = "array<struct<mask:int,score:double>>"

    def take(kept: Column, m: Column) -> Column:
        free = ~F.exists(kept, lambda k: F.array_contains(m["near"], k["mask"]))
        return F.when((F.size(kept) < keep) & free, F.concat(kept, F.array(F.struct(m["mask"].cast("int").alias("mask"), m["score"].cast("double").alias("score"))))).otherwise(kept)

    kept = F.aggregate(F.array_sort(F.collect_list(order)), F.array().cast(kind), take)
    return with_near.groupBy("image").agg(kept.alias("kept")).select("image", F.inline("kept"))


def label_map(masks: DataFrame) -> DataFrame:
    """image, y, x, mask: the mask of the highest score at each pixel, the lesser of equals (M3)."""
    return masks.groupBy("image", "y", "x").agg(F.max_by("mask", F.struct("score", -F.col("mask"))).alias("mask"))


def holes(masks: DataFrame, size: int) -> DataFrame:
    """image, mask, row: rows inside a mask's box that it does not touch."""
    box = masks.groupBy("image", "mask").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    inside = box.select("image", "mask", F.explode(F.sequence("a", "b")).alias("row"))
    return inside.where(F.col("row") < size).subtract(masks.select("image", "mask", F.col("y").alias("row")))


def merged_blocks(blocks: DataFrame, key: str, cells: str) -> DataFrame:
    """key, cells: the distinct cells of all of a key's blocks, in order."""
    return blocks.select(key, F.explode(cells).alias("c")).groupBy(key).agg(F.array_sort(F.collect_set("c")).alias(cells))


def mask_bank(masks: DataFrame) -> DataFrame:
    """image, masks: one nested record for each image (K6)."""
    one = masks.groupBy("image", "mask").agg(F.max("score").alias("score"), F.array_sort(F.collect_list((F.col("y") * 8 + F.col("x")).cast("int"))).alias("cells"))
    return one.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("mask", "score", "cells"))).alias("masks"))

"""Dataset manifests: labels, subsets, checks, class indices, splits, samples, shards and masks (J, D, U, W9, W13, P14, P18, A26, A27)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import hash_rank, order_rank, shuffled
from .scans import CHUNK, chunks


def attach_labels(items: DataFrame, labels: DataFrame, on: str = "path") -> DataFrame:
    """items with label, null where there is none."""
    return items.join(labels, on, "left")


def require_labels(items: DataFrame, labels: DataFrame, on: str = "path") -> DataFrame:
    """items with label; raises if one has none."""
    out = attach_labels(items, labels, on)
    if missing := out.where(F.col("label").isNull()).limit(1).count():
        raise ValueError(f"{missing or 'some'} items have no label")
    return out


def subset_by_list(items: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """items whose name is listed, with their class's index."""
    return items.join(wanted, "name").join(classes, "class")


def rehome(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """(name, class, target) for the annotated files that exist."""
    return files.join(annotations, "name").select("name", "class", F.concat_ws("/", "class", F.lit("images"), "name").alias("target"))


def not_done(items: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """items that are not in done."""
    return items.join(done, on, "left_anti")


def class_index(items: DataFrame, name: str = "class") -> DataFrame:
    """(class, index): dense, from 0, in order of name (W9). One row for each class goes to the ranking task."""
    return items.select(name).where(F.col(name).isNotNull()).distinct().select(name, (F.row_number().over(W.orderBy(name)) - 1).alias("index"))


def class_subset(items: DataFrame, classes: list[str], name: str = "class") -> DataFrame:
    """items of the classes; raises if one of them has none."""
    out = items.where(F.col(name).isin(*classes))
    if out.select(name).distinct().count() < len(set(classes)):
        raise ValueError("a class is absent")
    return out


def violations(items: DataFrame) -> DataFrame:
    """(idx, problem) for images that differ from most, are not square, have other than 1 or 3 channels, or a width that is no power of two."""
    shape = F.struct("width", "height", "channels")
    usual = items.groupBy(shape.alias("shape")).count().agg(F.max_by("shape", F.struct("count", F.struct(-F.col("shape.width"), -F.col("shape.height"), -F.col("shape.channels")))).alias("usual"))
    problems = F.array(
        F.when(shape != usual.scalar(), "shape"),
        F.when(F.col("width") != F.col("height"), "square"),
        F.when(~F.col("channels").isin(1, 3), "channels"),
        F.when(F.bit_count("width") != 1, "power"),
    )
    return items.select("idx", F.explode(problems).alias("problem")).where(F.col("problem").isNotNull())


def class_support(items: DataFrame, name: str = "class", idx: str = "idx") -> DataFrame:
    """Row indices of each class, ascending, and the least class size (A26). Indices of one class are one array, for classes that fit one; class_postings has no such bound."""
    out = items.groupBy(name).agg(F.array_sort(F.collect_list(idx)).alias("rows"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("least", F.min("n").over(W.partitionBy()))


def class_postings(items: DataFrame, name: str = "class", idx: str = "idx", *, size: int = CHUNK) -> DataFrame:
    """class, chunk, first, rows: the ascending row indices of each class in chunks of about `size`, and how many of the class come before (A26). A class of any size is many rows, made by many tasks."""
    return chunks(items, [name], idx, idx, size=size, kind=None).withColumnRenamed("values", "rows")


def posting(postings: DataFrame, at: DataFrame, name: str = "class") -> DataFrame:
    """at (class, place) with idx, the row at that place of the class (from 0). Only the chunk that holds it is opened."""
    held = postings.select(F.col(name).alias("__c"), "first", "rows")
    inside = F.col(name).eqNullSafe(F.col("__c")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.size("rows"))
    return at.join(held, inside).select(*at.columns, F.get("rows", (F.col("place") - F.col("first")).cast("int")).alias("idx"))


def label_shape(items: DataFrame, label: str = "label") -> DataFrame:
    """Number of classes (largest label + 1) and whether there are labels."""
    return items.agg((F.max(label) + 1).cast("long").alias("classes"), F.coalesce(F.bool_or(F.col(label).isNotNull()), F.lit(False)).alias("labelled"))


def shard_by_rank(items: DataFrame, by: str, shards: int) -> DataFrame:
    """Items i * shards + r modulo N for shard r, all shards equally long (D1); wrapped marks the repeats."""
    ranked = order_rank(items, by)
    n = items.count()
    rounds = -(-n // shards) * shards
    again = F.sequence(F.lit(0), F.floor((F.lit(rounds - 1) - F.col("rank")) / F.lit(max(n, 1))))
    out = ranked.where(F.col("rank") < rounds).withColumn("lap", F.explode(again))
    at = F.col("rank") + F.col("lap") * n
    return out.select(by, (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("place"), (F.col("lap") > 0).alias("wrapped"))


def batches(items: DataFrame, by: str, size: int, drop_last: bool = False) -> DataFrame:
    """items with batch."""
    out = order_rank(items, by)
    if drop_last:
        out = out.where(F.col("rank") < items.count() // size * size)
    return out.withColumn("batch", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def epoch_order(items: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """items with place, a new permutation in each epoch (D3)."""
    return hash_rank(items, shuffled(f"{seed}:{epoch}", F.col(key)), key, name="place")


def seeded_subset(items: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n items drawn by a seed, in no other order than the input's."""
    return hash_rank(items, shuffled(seed, F.col(key)), key).where(F.col("rank") < n).drop("rank")


def exact_split(items: DataFrame, key: str, seed: int, ratio: float) -> DataFrame:
    """items with split: the first int(n * ratio) of a permutation are `train`, the others `val`."""
    cut = int(items.count() * ratio)
    return hash_rank(items, shuffled(seed, F.col(key)), key).withColumn("split", F.when(F.col("rank") < cut, "train").otherwise("val")).drop("rank")


def mirrored(items: DataFrame) -> DataFrame:
    """items, then all of them again as mirrored."""
    return items.withColumn("flip", F.lit(False)).unionByName(items.withColumn("flip", F.lit(True)))


def draw_labels(items: DataFrame, label: str, by: str, seed: int, n: int) -> DataFrame:
    """(draw, label): n labels drawn with replacement by a hash of the draw."""
    spark = items.sparkSession
    size = items.count()
    picks = spark.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(shuffled(seed, F.col("id")), 1, 8), 16, 10).cast("long") % max(size, 1)).alias("rank"))
    return picks.join(order_rank(items.select(by, label), by), "rank").select("draw", label)


def random_subsets(items: DataFrame, key: str, subsets: int, m: int, keys: tuple[str, ...] = (), *, slack: float = 8.0) -> DataFrame:
    """(subset, key, ...): in each subset, the m rows of least hash, of each value of keys.

    A row goes only to the subsets in which its hash lies under a threshold that m rows and some more are expected to pass, so about
    subsets * m rows are shuffled and not subsets * N. How many passed is counted; where it was fewer than m of a larger table
    (slack: standard deviations of the count that are allowed for), the threshold rises for those subsets until it is not. The
    rows that pass are held (persisted) for counting and ranking."""
    named = [f"__k{i}" for i in range(len(keys))]
    if not keys:
        items, keys, named = items.withColumn("__all", F.lit(0)), ("__all",), ["__k0"]
    sizes = items.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)]).agg(F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for k, n in zip(keys, named):
        same &= F.col(k).eqNullSafe(F.col(n))
    sized = items.join(sizes, same).drop(*named)
    h = lambda s: F.md5(F.concat(s.cast("string"), F.lit(":"), F.col(key).cast("string")))
    digits, every = 12, F.sequence(F.lit(0), F.lit(subsets - 1))

    def passed(rows: DataFrame, among: Column, want: float) -> DataFrame:
        """Rows, once for each subset among those given in which their hash lies under the threshold for `want` rows."""
        share = F.least(F.lit(want) / F.col("__n"), F.lit(1.0))
        limit = F.when(share >= 1, "g").otherwise(F.lpad(F.lower(F.hex((share * float(16**digits)).cast("long"))), digits, "0"))
        out = rows.withColumn("__limit", limit).withColumn("subset", F.explode(F.filter(among, lambda s: h(s) < F.col("__limit"))))
        return out.withColumn("__h", h(F.col("subset"))).drop("__limit")

    want = m + slack * m**0.5 + slack * slack
    found = passed(sized, every, want).persist()
    while True:
        group = ["subset", *keys]
        counts = found.groupBy(*group).agg(F.count(F.lit(1)).alias("__c"))
        grid = sizes.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], "__n", F.explode(every).alias("subset"))
        met = F.col("g.subset") == F.col("c.subset")
        for k in keys:
            met &= F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}"))
        short = grid.alias("g").join(counts.alias("c"), met, "left").where(F.coalesce("__c", F.lit(0)) < F.least(F.lit(m), F.col("__n")))
        if not short.limit(1).count():
            break
        want *= 2
        again = short.groupBy(*[F.col(f"g.{k}").alias(n) for k, n in zip(keys, named)]).agg(F.collect_set("g.subset").alias("__again"))
        kept = found.alias("f").join(short.select(*[f"g.{c}" for c in group]).alias("s"), [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group], "left_anti")
        more = sized.join(again, same)
        found = kept.unionByName(passed(more, F.col("__again"), want).select(*kept.columns)).persist()
    place = F.row_number().over(W.partitionBy("subset", *keys).orderBy("__h", key))  # a group has m rows and a few more
    return found.withColumn("__place", place).where(F.col("__place") <= m).drop("__place", "__h", "__n", "__all")


def label_grid(items: DataFrame, label: str, key: str, seed: int, width: int, rows: int) -> DataFrame:
    """(y, x, key): a grid whose row y shows label number y mod L (labels in order), filled in turn from its shuffled members."""
    spark = items.sparkSession
    labels = items.select(label).distinct().select(F.col(label), (F.row_number().over(W.orderBy(label)) - 1).alias("li"))
    count = labels.count()
    members = hash_rank(items.select(label, key), shuffled(seed, F.col(key)), key, keys=(label,))
    sizes = members.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    cells = spark.range(rows * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    placed = cells.withColumn("li", F.col("y") % max(count, 1)).join(labels.join(sizes, label), "li")
    rank = (width * F.floor(F.col("y") / max(count, 1)) + F.col("x")) % F.col("size")
    return placed.withColumn("rank", rank.cast("long")).join(members, [label, "rank"]).select("y", "x", label, key)


def random_patches(ids: DataFrame, key: str, patches: int, ratio: float, seed: int) -> DataFrame:
    """key with kept: the patches that stay, round(patches * (1 - ratio)) of them, in order."""
    keep = round(patches * (1 - ratio))
    scored = F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), p.cast("string"))).alias("h"), p.alias("p")))
    return ids.select(key, F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, keep), lambda s: s["p"])).alias("kept"))


def mixed_strategy(key: str, seed: int, share: float = 0.75) -> Column:
    """`block` for that share of the keys, `random` for the others."""
    u = F.conv(F.substring(shuffled(seed, F.col(key)), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return F.when(u < share, "block").otherwise("random")


def block_size(u: float, grid: tuple[int, int], scale: tuple[float, float], aspect: tuple[float, float]) -> tuple[int, int]:
    """Height and width of a block: one number u in 0 to 1 sets both its share of the grid and its aspect; a side is less than the grid's."""
    area = int(grid[0] * grid[1] * (scale[0] + u * (scale[1] - scale[0])))
    ratio = aspect[0] + u * (aspect[1] - aspect[0])
    return min(grid[0] - 1, round((area * ratio) ** 0.5)), min(grid[1] - 1, round((area / ratio) ** 0.5))


def multiblock_masks(ids: DataFrame, key: str, *, batch: int = 64, grid: tuple[int, int] = (14, 14), seed: int = 0, targets: int = 4, contexts: int = 1, min_keep: int = 10, timeout: int = 20, target_scale: tuple[float, float] = (0.15, 0.2), aspect: tuple[float, float] = (0.75, 1.5), context_scale: tuple[float, float] = (0.85, 1.0), overlap: bool = False) -> DataFrame:
    """key, batch, contexts, targets: patches of blocks on a grid, ascending.

    `batch` keys in order make a batch, whose size of target blocks and of context blocks are drawn once; places are drawn for each
    block, the last row and column excluded. A context block leaves out the targets' patches unless overlap; after `timeout` places
    that leave min_keep patches or fewer, it stops leaving out the last target, and so on. All masks of a batch are cut to its
    least. Draws are hashes of the seed with the batch, or with the key, block and attempt. Sizes that can come to min_keep
    patches or fewer are refused at once."""
    h, w = grid
    least = min(math.prod(block_size(u / 4096, grid, *x)) for u in range(4097) for x in ((target_scale, aspect), (context_scale, (1.0, 1.0))))
    if least <= min_keep:
        raise ValueError(f"a block can have {least} patches, no more than {min_keep}: take a larger grid or a smaller min_keep")

    def draw(tag: str) -> float:
        return int(hashlib.md5(f"{seed}:{tag}".encode()).hexdigest()[:8], 16) / (1 << 32)

    def place(tag: str, size: tuple[int, int], others: list[np.ndarray]) -> np.ndarray:
        for attempt in range(timeout * (len(others) + 1)):
            mask = np.zeros(grid, bool)
            top, left = int(draw(f"{tag}:{attempt}:y") * (h - size[0])), int(draw(f"{tag}:{attempt}:x") * (w - size[1]))
            mask[top : top + size[0], left : left + size[1]] = True
            for other in others[: len(others) - attempt // timeout]:
                mask &= ~other
            if mask.sum() > min_keep:
                break
        return mask

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = []
            for k, b in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                sizes = [block_size(draw(f"{b}:{n}"), grid, *x) for n, x in (("target", (target_scale, aspect)), ("context", (context_scale, (1.0, 1.0))))]
                found = [place(f"{k}:t{i}", sizes[0], []) for i in range(targets)]
                rest = [place(f"{k}:c{i}", sizes[1], [] if overlap else found) for i in range(contexts)]
                rows.append([[np.flatnonzero(m).tolist() for m in ms] for ms in (rest, found)])
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*frame.columns, *[pa.array([r[i] for r in rows], lists) for i in range(2)]], names=[key, "batch", "contexts", "targets"])

    rows = batches(ids.select(key), key, batch)
    made = rows.mapInArrow(run, f"{key} {ids.schema[key].dataType.simpleString()}, batch long, contexts array<array<int>>, targets array<array<int>>")

    def trimmed(name: str) -> tuple[Column, Column]:
        least = F.min(F.array_min(F.transform(name, F.size))).over(W.partitionBy("batch"))
        return F.transform(name, lambda m: F.slice(m, 1, F.col(f"__{name}"))).alias(name), least

    found = {n: trimmed(n) for n in ("contexts", "targets")}
    return made.withColumns({f"__{n}": x[1] for n, x in found.items()}).select(key, "batch", *[x[0] for x in found.values()])


def packed_names(items: DataFrame, labels: DataFrame, idx: str = "idx") -> DataFrame:
    """idx, archive name and label, which is null for all unless all have one (K2)."""
    out = items.join(labels, "path", "left")
    padded = F.lpad(F.col(idx).cast("string"), 8, "0")
    complete = out.agg(F.bool_and(F.col("label").isNotNull()))
    return out.select(idx, F.concat(F.substring(padded, 1, 5), F.lit("/img"), padded, F.lit(".png")).alias("name"), F.when(complete.scalar(), F.col("label")).alias("label"))

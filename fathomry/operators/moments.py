"""Mergeable moments of feature tables, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import args_key
from .tiles import _matrix

#: Bytes of sums that a task holds.
HELD = 256 << 20


def partial(features: DataFrame, key: str = "side", x: str = "x") -> DataFrame:
    """key, i, row: for i >= 0, row i of the sum of outer products; for i = -1 the sum of vectors; for i = -2 the count. Each task sums its rows before anything is shuffled, and sends on what it has when the sums of many keys come to `HELD` bytes."""

    def sent(sums: dict[object, list[np.ndarray]], kinds: pa.DataType) -> Iterator[pa.RecordBatch]:
        for k, (n, s, g) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (2 + len(g)), kinds), pa.array([-2, -1, *range(len(g))], pa.int32()), pa.array([n.tolist(), s.tolist(), *g.tolist()])], names=["k", "i", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, list[np.ndarray]] = {}
        kinds = None
        for batch in batches:
            kinds = batch.column(0).type
            t = pa.Table.from_batches([batch])
            names = t.column(key).to_numpy(zero_copy_only=False)
            m = _matrix(t.column(x))
            for k in set(names.tolist()):
                rows = m[names == k]
                got = [np.array([len(rows)], float), rows.sum(axis=0), rows.T @ rows]
                sums[k] = [a + b for a, b in zip(sums[k], got)] if k in sums else got
            if sums and len(sums) * m.shape[1] ** 2 * 8 > HELD:
                yield from sent(sums, kinds)
                sums = {}
        yield from sent(sums, kinds)

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, x).mapInArrow(run, f"k {kind}, i int, row array<double>").withColumnRenamed("k", key)


def merged(parts: DataFrame, key: str = "side") -> DataFrame:
    """parts with equal (key, i) added up (A36): stored moments and new ones merge alike."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({key: t.column(key).slice(0, 1), "i": t.column("i").slice(0, 1), "row": pa.array([_matrix(t.column("row")).sum(axis=0).tolist()])})

    return parts.groupBy(key, "i").applyInArrow(run, parts.schema)


def covariance(moments: DataFrame, key: str = "side", *, sample: bool = False) -> DataFrame:
    """key, i, j, mean_i, cov: population (divide by n) or sample (by n - 1) covariance in long form."""
    n = moments.where("i = -2").select(key, F.get("row", F.lit(0)).alias("n"))
    s = moments.where("i = -1").select(key, F.col("row").alias("s"))
    g = moments.where("i >= 0").select(key, "i", F.posexplode("row").alias("j", "g")).join(n.join(s, key), key)
    mean_i, mean_j = F.get("s", F.col("i")) / F.col("n"), F.get("s", F.col("j")) / F.col("n")
    cov = F.col("g") / F.col("n") - mean_i * mean_j
    return g.select(key, "i", "j", mean_i.alias("mean_i"), (cov * F.col("n") / (F.col("n") - 1) if sample else cov).alias("cov"))


def collected(moments: DataFrame, key: str = "side", *, most: int = 16) -> dict:
    """key -> (n, mean, population covariance): D + 2 rows for each key come to the driver; more keys than `most` are refused."""
    if moments.where("i = -2").limit(most + 1).count() > most:
        raise ValueError(f"moments of more than {most} keys stay a table: take covariance()")
    out: dict = {}
    for r in moments.collect():
        out.setdefault(r[key], {})[r["i"]] = np.array(r["row"])
    made = {}
    for k, rows in out.items():
        n, mean = rows[-2][0], rows[-1] / rows[-2][0]
        g = np.stack([rows[i] for i in range(len(mean))])
        made[k] = (n, mean, g / n - np.outer(mean, mean))
    return made


def frechet(a: tuple, b: tuple) -> float:
    """Squared gap of means plus tr(Ca + Cb - 2 sqrt(Ca Cb)), the root through eigenvalues of a symmetric matrix."""
    (_, ma, ca), (_, mb, cb) = a, b
    values, vectors = np.linalg.eigh(ca)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cb @ root), 0)).sum()
    return float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * cross)


def frechet_distance(features: DataFrame, key: str = "side", x: str = "x") -> DataFrame:
    """One row: frechet, of the two values of key (A2)."""
    found = collected(merged(partial(features, key, x), key), key)
    a, b = (found[k] for k in sorted(found))
    return features.sparkSession.createDataFrame([(frechet(a, b),)], "frechet double")


def descriptors(features: DataFrame, x: str = "x", tol: float = 0.1) -> DataFrame:
    """One row (A19): mean absolute correlation off the diagonal (-1 if one is not defined), the same with those that are not as 0, rank and rank ratio at a tolerance, mean sample deviation, anisotropy (share of the first singular value's square, not centred)."""
    one = features.select(F.lit(0).alias("side"), x)
    n, mean, cov = collected(merged(partial(one, "side", x)))[0]
    sd = np.sqrt(np.maximum(np.diag(cov), 0) * n / (n - 1))
    pop = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = cov / np.outer(pop, pop)
    off = np.abs(corr[~np.eye(len(mean), dtype=bool)])
    squares = np.maximum(np.linalg.eigvalsh((cov + np.outer(mean, mean)) * n), 0)
    rank = int((np.sqrt(squares) > tol).sum())
    safe = float(np.nansum(off) / max(len(off), 1))
    row = (-1.0 if np.isnan(off).any() else safe, safe, rank, rank / min(int(n), len(mean)), float(sd.mean()), float(squares.max() / squares.sum()))
    return features.sparkSession.createDataFrame([row], "mean_corr double, nansafe_corr double, rank long, rank_ratio double, mean_std double, anisotropy double")


def cached_moments(features: DataFrame, path: str, args: dict, key: str = "side", x: str = "x") -> DataFrame:
    """Moments from a table of them, made first if its key is missing (K4). The key is the MD5 of the arguments."""
    spark, name = features.sparkSession, args_key(args)
    try:
        store = spark.read.parquet(path).where(F.col("cache_key") == name)
        missing = store.limit(1).count() == 0
    except Exception as e:  # a store not yet written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = True
    if missing:
        merged(partial(features, key, x), key).withColumn("cache_key", F.lit(name)).write.mode("append").partitionBy("cache_key").parquet(path)
    return spark.read.parquet(path).where(F.col("cache_key") == name).drop("cache_key")


def view_terms(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (A37): mean squared gap of paired views, mean hinge of 1 over the deviation of each dimension, and covariance energy off the diagonal over the dimension, both summed over the views."""
    gap = pairs.agg(F.avg(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v) / F.size(a)).alias("invariance"))
    both = pairs.select(F.lit("a").alias("side"), F.col(a).alias("x")).union(pairs.select(F.lit("b"), F.col(b)))
    cov = covariance(merged(partial(both)), sample=True)
    dim = F.max("i") + 1
    terms = cov.groupBy("side").agg((F.sum(F.when(F.col("i") == F.col("j"), F.greatest(F.lit(0.0), 1 - F.sqrt(F.col("cov") + 1e-4)))) / dim).alias("v"), (F.sum(F.when(F.col("i") != F.col("j"), F.col("cov") * F.col("cov"))) / dim).alias("c"))
    sums = terms.agg((F.sum("v") / 2).alias("variance"), F.sum("c").alias("covariance"))
    return gap.select("invariance", sums.select("variance").scalar().alias("variance"), sums.select("covariance").scalar().alias("covariance"))

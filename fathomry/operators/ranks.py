"""Ranks over whole tables without a window that holds one.

Rows are dealt to buckets that follow the wanted order, ranked inside their bucket, and shifted by the counts of the buckets
before. Buckets come from the key itself (the first digits of an MD5, or cuts at approximate percentiles), so a task that
runs again deals alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import at_or_below


def shuffled(seed: int | str, key: Column) -> Column:
    """The sort key of a seeded permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _ranked(df: DataFrame, keys: list[str], by: list[Column], name: str) -> DataFrame:
    """df has __b, a bucket that follows the order. keys: rank inside each of their values."""
    counts = df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c"), before.alias("__o"))
    same = F.col("__b") == F.col("__c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*by)) - 1)
    return inside.join(offsets, same).withColumn(name, (F.col("__r") + F.col("__o")).cast("long")).drop("__b", "__c", "__o", "__r", *[f"__k{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, key: Column, tie: str, *, keys: tuple[str, ...] = (), digits: int = 3, name: str = "rank") -> DataFrame:
    """Rank from 0 by a hexadecimal hash, then tie; inside each value of keys. Each key's rows are dealt to 16 ** digits buckets."""
    df = df.withColumn("__h", key)
    return _ranked(df.withColumn("__b", F.substring("__h", 1, digits)), list(keys), [F.col("__h"), F.col(tie)], name).drop("__h")


def order_rank(df: DataFrame, by: str, *, rows: int = 1 << 18, name: str = "rank") -> DataFrame:
    """Rank from 0 by a numeric column without ties. A bucket has about so many rows, or a 4096th of the table, if that is more."""
    most = 4096
    n, cuts = df.agg(F.count(F.lit(1)), F.percentile_approx(by, [i / most for i in range(1, most)], 10 * most)).first()
    cuts = sorted(set((cuts or [])[:: max(1, most * rows // max(n, 1))]))
    listed = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(f"array<{df.schema[by].dataType.simpleString()}>")
    dealt = df.withColumn("__cuts", listed).withColumn("__b", at_or_below("__cuts", F.col(by), max(1, len(cuts))))
    return _ranked(dealt.drop("__cuts"), [], [F.col(by)], name)


#: Cuts of a round of narrowing; values that may be collected to end it.
CUTS, FEW = 128, 4096


def values_at_ranks(df: DataFrame, value: str, wanted: list[int]) -> list[float]:
    """The values of a numeric column that hold the given ranks from 0, exactly. Null and NaN have no rank.

    Each round cuts the interval in which a rank lies at its rows' own approximate percentiles, and counts exactly what lies on
    each cut and between two; counts are taken inside tasks, where they are a few hundred numbers however many the rows, and
    added up. So a round leaves about 1/128 of the rows, or one value, whatever the skew; when no more than `FEW` rows are left they are
    collected. No value is shuffled, sorted or ranked by a window."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    state = {t: (float("-inf"), float("inf"), 0) for t in range(len(wanted))}  # open interval and rows before it
    out: dict[int, float] = {}
    while state:
        closed = {t: a == -np.inf and b == np.inf for t, (a, b, _) in state.items()}  # at first all values, infinite ones too
        inside = {t: F.lit(True) if closed[t] else (F.col("v") > a) & (F.col("v") < b) for t, (a, b, _) in state.items()}
        told = rows.agg(*[x.alias(f"{n}{t}") for t, c in inside.items() for n, x in (("n", F.count(F.when(c, 1))), ("c", F.percentile_approx(F.when(c, F.col("v")), [i / CUTS for i in range(CUTS + 1)], 10 * CUTS)))]).first()
        cuts: dict[int, np.ndarray] = {}
        for t in list(state):
            a, b, before = state[t]
            if told[f"n{t}"] <= FEW:
                left = np.sort([r["v"] for r in rows.where(inside[t]).collect()])
                out[t] = float(left[wanted[t] - before])
                del state[t]
            else:
                cuts[t] = np.unique(told[f"c{t}"])
        if not cuts:
            break
        bounds = {t: state[t][:2] for t in cuts}
        found = _histogram(rows, cuts, bounds, closed)
        for t, counts in found.items():
            before = state[t][2]
            ends = before + np.cumsum(counts)
            at = int(np.searchsorted(ends, wanted[t], "right"))
            if at % 2:  # on a cut
                out[t] = float(cuts[t][at // 2])
                del state[t]
            else:
                a, b, _ = state[t]
                k = at // 2
                state[t] = (float(cuts[t][k - 1]) if k else a, float(cuts[t][k]) if k < len(cuts[t]) else b, int(ends[at] - counts[at]))
    return [out[t] for t in range(len(wanted))]


def _histogram(rows: DataFrame, cuts: dict[int, np.ndarray], bounds: dict[int, tuple[float, float]], closed: dict[int, bool]) -> dict[int, np.ndarray]:
    """For each target how many values of its interval lie below its first cut, on it, between it and the next, and so on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros(2 * len(c) + 1, np.int64) for t, c in cuts.items()}
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            for t, c in cuts.items():
                a, b = bounds[t]
                mine = v if closed[t] else v[(v > a) & (v < b)]
                left = np.searchsorted(c, mine)
                on = np.searchsorted(c, mine, "right") - left
                sums[t] += np.bincount(2 * left + on, minlength=len(sums[t]))
        for t, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["t", "at", "n"])

    out = {t: np.zeros(2 * len(c) + 1, np.int64) for t, c in cuts.items()}
    for r in rows.mapInArrow(count, "t int, at int, n long").groupBy("t", "at").agg(F.sum("n").alias("n")).collect():
        out[r["t"]][r["at"]] = r["n"]
    return out

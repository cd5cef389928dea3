"""Folds in order as parallel prefixes (W6, W7; T4, T5 in streams).

A step of a moving average is an affine map, and a step of an integrator held in bounds is a clipped shift. Both are closed under
composition, so a series is cut into chunks, each chunk's steps are composed in a task of their own, and only one small map for
each chunk is folded to the end. Cuts of a long series lie at its own percentiles of the order column; shorter ones are one chunk.
Rows of equal order follow one another by value and are never parted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a chunk, about.
CHUNK = 1 << 18


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out &= F.col(x).eqNullSafe(F.col(y))
    return out


def at_or_below(cuts: str, x: Column, most: int) -> Column:
    """How many of the ascending cuts, `most` at most, are at or below x: by halving."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("a"), s["b"].alias("b"))
        left = F.struct(s["a"].alias("a"), mid.alias("b"))
        return F.when(s["a"] >= s["b"], s).when(F.get(cuts, mid) <= x, right).otherwise(left)

    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), F.struct(F.lit(0).alias("a"), F.size(cuts).alias("b")), step, lambda s: s["a"])


def long_series(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame | None:
    """df with __chunk: the number, along the order, of the stretch of about `size` rows in which a row of its series lies; 0 in series of no more rows. None if no series has more."""
    other = [f"__c{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, other)]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return None
    parts = -(-most // size)
    long = df.join(counts, _same(keys, other), "left_semi")
    cuts = long.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, other)]).agg(F.array_distinct(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)).alias("__cuts"))
    chunk = F.when(F.col("__cuts").isNull(), 0).otherwise(at_or_below("__cuts", F.col(order), parts))
    return df.join(cuts, _same(keys, other), "left").withColumn("__chunk", chunk).drop("__cuts", *other)


def beside(rows: DataFrame, keys: list[str], totals: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """rows (with __chunk) with columns told of the chunks before theirs. totals: aggregates of a chunk; before: aggregates over those of all chunks before."""
    group = [*keys, "__chunk"]
    at = [f"__b{i}" for i in range(len(group))]
    sums = rows.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()])
    told = sums.select(*[F.col(g).alias(b) for g, b in zip(group, at)], *[c.over(W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)).alias(n) for n, c in before.items()])
    return rows.join(told, _same(group, at)).drop(*at)


def chunks(df: DataFrame, keys: list[str], order: str, value: str, *, size: int = CHUNK, kind: str | None = "double") -> DataFrame:
    """keys, chunk, first (rows of the series before it), values (in order). chunk counts up along the series; a null value is a step without effect and is left out, and so is a null order. kind: the type of values; None: as they are."""
    named = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(order).alias("__o"), (F.col(value).cast(kind) if kind else F.col(value)).alias("__v")).where("__o is not null and __v is not null")
    dealt = long_series(rows, named, "__o", size)
    rows = rows.withColumn("__chunk", F.lit(0)) if dealt is None else dealt
    group = [*named, "__chunk"]
    made = rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda s: s["__v"]).alias("values"))
    back = [*[F.col(n).alias(k) for n, k in zip(named, keys)], F.col("__chunk").alias("chunk")]
    if dealt is None:
        return made.select(*back, F.lit(0).cast("long").alias("first"), "values")
    at = [f"__b{i}" for i in range(len(group))]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*named).orderBy("__chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    firsts = sizes.select(*[F.col(g).alias(b) for g, b in zip(group, at)], before.alias("first"))
    return made.join(firsts, _same(group, at)).select(*back, "first", "values")


def ema_map(values: str, first: str, decay: float) -> Column:
    """(i, a, b): the steps of a chunk take x to a * x + b; i: rows of the series up to its end. The decay warms up as (1 + i) / (10 + i)."""

    def step(s: Column, v: Column) -> Column:
        d = F.when(s["i"] == 0, 0.0).otherwise(F.least(F.lit(decay), (s["i"] + 1) / (s["i"] + 10)))
        return F.struct((s["i"] + 1).alias("i"), (s["a"] * d).alias("a"), (v + (s["b"] - v) * d).alias("b"))

    return F.aggregate(values, F.struct(F.col(first).cast("double").alias("i"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), step)


def clip_map(values: str, shift: Callable[[Column], Column], low: float, high: float) -> Column:
    """(s, lo, hi): the steps of a chunk take p to p + s, held in lo to hi. shift: value to the shift of its step."""
    hold = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))

    def step(m: Column, v: Column) -> Column:
        c = shift(v)
        return F.struct((m["s"] + c).alias("s"), hold(m["lo"] + c).alias("lo"), hold(m["hi"] + c).alias("hi"))

    wide = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    return F.aggregate(values, wide, step)


def joined(maps: DataFrame, keys: list[str], start: Column, apply: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, n, x: the maps (chunk, n, m) of each series applied in order to a start."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "m"))), lambda s: s["m"])
    return maps.groupBy(*keys).agg(F.sum("n").alias("n"), listed.alias("maps")).select(*keys, "n", F.aggregate("maps", start, apply).alias("x"))


def affine_prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the maps x -> a * x + b, one after the other, the composition up to each: by doubling."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] = b[step:] + a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def clip_prefixes(shift: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the maps p -> p + shift held in low to high, one after the other, the composition (s, lo, hi) up to each: by doubling."""
    s, step = shift.astype(float), 1
    lo, hi = np.full(len(s), low), np.full(len(s), high)
    while step < len(s):
        lo_, hi_ = np.clip(lo[:-step] + s[step:], lo[step:], hi[step:]), np.clip(hi[:-step] + s[step:], lo[step:], hi[step:])
        s[step:] = s[step:] + s[:-step]
        lo[step:], hi[step:] = lo_, hi_
        step *= 2
    return s, lo, hi

"""Registries of runs: shape, label, filter, best of a group, pivot and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """df with each nested field as a column of its own, named by its path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            at = (*path, f.name)
            out += leaves(f.dataType, at) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))]
        return out

    return df.select(*leaves(df.schema, ()))


def filled(template: str) -> Column:
    """A template's `{column}` places filled from columns."""
    parts: list[Column] = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.col(piece).cast("string") if k % 2 else F.lit(piece))
    return F.concat(*parts)


def replaced(x: str, by: dict[str, str]) -> Column:
    """Values by a dictionary; others stay."""
    return F.coalesce(mapped(x, by), F.col(x))


def mapped(x: str, by: dict) -> Column:
    """Values by a dictionary; others are null."""
    table = F.create_map(*[F.lit(v) for kv in by.items() for v in kv])
    return F.try_element_at(table, F.col(x))


def last_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the last rule that holds (P5)."""
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), rules, F.lit(default).cast("string"))


def without_empty(df: DataFrame) -> DataFrame:
    """df less the columns that are null throughout."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def with_reference(df: DataFrame, reference: DataFrame, keys: list[str], value: str, fallback: float) -> DataFrame:
    """df with a value looked up by keys, else the fallback."""
    return df.join(reference, keys, "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def best_rows(df: DataFrame, keys: list[str], metric: str, tie: str) -> DataFrame:
    """The row of the largest metric in each group: the first of equals, no nulls, no null keys (W1). An aggregate, so a large group is summed where it lies."""
    ok = F.col(metric).isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    row = F.max_by(F.struct("*"), F.struct(F.col(metric).alias("m"), (-F.col(tie)).alias("t")))
    return df.where(ok).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row.alias("r")).select("r.*")


def best_and_last(df: DataFrame, keys: list[str], value: str, epoch: str) -> DataFrame:
    """keys, best, last."""
    return df.groupBy(*keys).agg(F.max(value).alias("best"), F.max_by(value, epoch).alias("last"))


def pivoted_best(df: DataFrame, rows: list[str], column: str, values: list[str], metric: str) -> DataFrame:
    """Largest metric of each group, with a column for each given value."""
    return df.dropna(subset=rows).groupBy(*rows).pivot(column, values).agg(F.max(metric))


def subset_mean(df: DataFrame, keep: Column, keys: list[str], value: str) -> DataFrame:
    """Mean over a reference subset."""
    return df.where(keep).groupBy(*keys).agg(F.avg(value).alias("mean"))


def group_max(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Largest of several columns in each group."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*[F.max(m).alias(m) for m in metrics])


def in_order(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The rows whose value is in a list, with its place there (O3)."""
    places = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{by} string, place int")
    return df.join(places, by).orderBy("place")


def next_number(names: DataFrame, name: str = "name") -> DataFrame:
    """next: one more than the largest number that names begin with; 0 if none does."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(name, r"^(\d+)", 1).try_cast("long")), F.lit(-1)) + 1).alias("next"))


def top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of the highest score in each group (O2)."""
    w = W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def training_cost(df: DataFrame, *, gpus: Column) -> DataFrame:
    """df with hours: seconds an epoch, times epochs, times devices."""
    return df.withColumn("gpu_hours", F.col("epoch_s") * F.col("epochs") * gpus / 3600)

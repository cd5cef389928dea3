"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, language, topic). Rounds of raking scale the cells' token weights to each
dimension's target in turn and hold every weight at what the cell has, so weight / tokens is a probability; a document is
kept if a hash of its id falls below its cell's. Only cells, never documents, are raked. A cell table of at most `TOGETHER`
rows is raked in one task without a shuffle; a larger one by windows over the dimension's values.

Only DataFrame functions are used. Defined results: nulls of a dimension are a value of their own; a null or empty text has
no tokens and is kept with its cell's probability, or 0 in a cell without tokens; rows with equal ids are kept or dropped
together; texts may be of any length; an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, without, written

TOGETHER = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """A rough topic by form: table, web, contact or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("://")), "web").when(F.contains(t, F.lit("@")), "contact").otherwise("prose")


def cells(docs: DataFrame, dims: list[str], size: str = "tokens") -> DataFrame:
    """dims, t (tokens); written, since it is small and raked often."""
    out = written(docs.groupBy(*dims).agg(F.sum(size).cast("double").alias("t")), "cells")
    return written(out.coalesce(1), "cells") if out.count() <= TOGETHER else out


def tempered(found: DataFrame, powers: dict[str, float]) -> DataFrame:
    """found with goal_<dim>: the share of tokens each value of a dimension should have, its own share to a power (1 keeps the mix, 0 is uniform)."""
    for dim, power in powers.items():
        values = found.groupBy(dim).agg(F.sum("t").alias("of"))
        goals = values.select(F.col(dim).alias("__v"), F.when(F.col("of") > 0, F.pow("of", F.lit(power))).otherwise(0.0).alias("__g"))
        whole = goals.agg(F.sum("__g")).first()[0] or 1.0
        found = found.join(goals, found[dim].eqNullSafe(goals["__v"])).withColumn(f"goal_{dim}", F.col("__g") / F.lit(whole)).drop("__v", "__g")
    return found


def rake(found: DataFrame, dims: list[str], *, share: float, rounds: int) -> DataFrame:
    """found (dims, t, goal_<dim>) with w, the tokens to take of each cell: raked to share of all tokens, never more than the cell has."""
    budget = share * (found.agg(F.sum("t")).first()[0] or 0.0)
    found = found.withColumn("w", F.col("t") * share)
    if found.count() <= TOGETHER:
        found = found.coalesce(1)
    for _ in range(rounds):
        for dim in dims:
            of = F.sum("w").over(W.partitionBy(dim))
            found = found.withColumn("w", F.when(of > 0, F.least("t", F.col("w") * (F.lit(budget) * F.col(f"goal_{dim}")) / of)).otherwise(0.0))
        found = written(found, "raked")
    return found


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from a key: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, dims: list[str], powers: dict[str, float], *, key: str = "doc_id", size: str = "tokens", share: float = 0.7, rounds: int = 12, seed: int = 7) -> DataFrame:
    """docs with probability and sampled."""
    docs = without(docs, "probability", "sampled")
    raked = rake(tempered(cells(docs, dims, size), powers), dims, share=share, rounds=rounds)
    odds = raked.select(*[F.col(d).alias(f"__{d}") for d in dims], F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("probability"))
    same = F.lit(True)
    for d in dims:
        same &= F.col(d).eqNullSafe(F.col(f"__{d}"))
    return docs.join(odds, same).drop(*[f"__{d}" for d in dims]).withColumn("sampled", uniform(key, seed) < F.col("probability"))


DIMS = ["source", "lang", "topic"]
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", topic().alias("topic"), tokens().alias("tokens"))
    out = mix(written(docs, "sized"), DIMS, POWERS)
    return out.select("doc_id", *DIMS, "tokens", F.round("probability", 6).alias("probability"), "sampled")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the sampled documents."""
    sized = written(docs.select("doc_id", "source", "lang", topic().alias("topic"), tokens().alias("tokens")), "sized")
    raked = rake(tempered(cells(sized, DIMS), POWERS), DIMS, share=0.7, rounds=12)
    odds = raked.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("__p"))
    same = F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")) & topic().eqNullSafe(F.col("__topic"))
    return docs.join(odds, same).where(uniform("doc_id", 7) < F.col("__p")).select(*docs.columns)


def _oracle() -> str:
    sql = r"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\v\f]+')) AS tokens,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '://') THEN 'web'
      WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic
  FROM documents
), c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t FROM d GROUP BY ALL)"""
    for dim, power in POWERS.items():
        sql += f""", g_{dim} AS (
  SELECT {dim} AS v, pow(sum(t), {power}) / sum(pow(sum(t), {power})) OVER () AS g FROM c GROUP BY {dim})"""
    sql += """, r0 AS (
  SELECT c.*, g_source.g AS goal_source, g_lang.g AS goal_lang, g_topic.g AS goal_topic, t * 0.7 AS w,
    0.7 * sum(t) OVER () AS budget FROM c """ + " ".join(f"JOIN g_{d} ON c.{d} IS NOT DISTINCT FROM g_{d}.v" for d in DIMS) + ")"
    k = 0
    for _ in range(12):
        for dim in DIMS:
            sql += f""", r{k + 1} AS (
  SELECT * REPLACE (least(t, w * (budget * goal_{dim}) / sum(w) OVER (PARTITION BY {dim})) AS w) FROM r{k})"""
            k += 1
    return sql + f"""
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(w / t, 6) AS probability,
  ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < w / t AS sampled
FROM d JOIN r{k} AS r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic
"""


ORACLE = _oracle()

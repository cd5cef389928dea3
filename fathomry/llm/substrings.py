"""Substring dedup: words of every window of `length` words that also starts in an earlier document are removed.

Suffixes at anchors are parted by their first words. A prefix of `PREFIX` words makes a group; groups of copies are settled as
they are sorted, a group of up to `GROUP` other suffixes is sorted in memory, which gives the nodes of its subtree, and a
larger one is parted by a longer prefix, of all words of a window. A node `length` words deep with suffixes of several documents
is a repeat; `maximal_repeats` joins the windows of such nodes that follow one another. See repeats.py and subtrees.py; README.md
says why suffixes at anchors stand for all.

Defined results: a null text, or one without words, has none; texts of fewer words than `length` stay whole; texts may be of
any length; equal rows are one document, and of a window found in several documents the least id keeps it; different texts with one id are not
earlier than each other; null ids come before
all others; an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import cut, repeated_spans

PREFIX = 5


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = 13) -> DataFrame:
    """doc, first (word), words: maximal runs of words that windows found in earlier documents cover. A null id is the least long."""
    spans = repeated_spans(docs, doc_id, text, "words", length=length, k=max(1, min(PREFIX, length)), same_doc=False)
    first, many = F.shiftright("span", 32), F.shiftright("span", 16).bitwiseAND(0xFFFF)
    at = spans.select("doc", "tag", first.alias("a"), (first + many + length - 1).alias("b"))
    before = F.expr("max(b) over (partition by doc, tag order by a, b rows between unbounded preceding and 1 preceding)")
    runs = at.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("run", F.expr("sum(new) over (partition by doc, tag order by a, b)"))
    return runs.groupBy("doc", "tag", "run").agg(F.min("a").alias("first"), (F.max("b") - F.min("a")).alias("words")).drop("tag", "run")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = 13) -> DataFrame:
    """docs, less the text, with n_symbols (words), n_removed, n_spans and kept (words joined by one space, as bytes)."""
    spans = repeated_spans(docs, doc_id, text, "words", length=length, k=max(1, min(PREFIX, length)), same_doc=False)
    return cut(docs, doc_id, text, "words", spans, length=length, joint=b" ")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))

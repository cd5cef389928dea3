"""Suffix-array dedup: bytes of every string of `length` that also starts earlier are removed.

A sparse suffix array. Suffixes are sampled at anchors; tuples of them (name of the substring at the anchor, name of all bytes
around it, document, place) go through Spark's external sort, which spills and is read as a stream, as disk-backed queues
are. Copies are settled by their names. What names leave open is sorted by its bytes, group by group, with the common prefixes
of neighbours; the order of the suffixes at anchors and of the bytes before them, step by step to the left, gives the classes
of all suffixes between anchors, as in induced sorting. Groups too large for memory recur with the whole string as name. See
repeats.py and subtrees.py; README.md says why the full array is not kept.

Defined results: a null or empty text has no bytes; texts shorter than `length` stay whole; texts may be of any length; equal
rows are one document, and of equal strings that of the least id, then the first start, stays; different texts with one id are not earlier than each other; null ids come before all others; an
empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import cut, repeated_spans

ANCHOR = 48


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = 100, as_text: bool = False) -> DataFrame:
    """docs, less the text, with n_symbols (bytes), n_removed, n_spans and kept (bytes; as_text: a string)."""
    spans = repeated_spans(docs, doc_id, text, "bytes", length=length, k=max(1, min(ANCHOR, length * 12 // 25)), same_doc=True)
    return cut(docs, doc_id, text, "bytes", spans, length=length, joint=b"", as_text=as_text)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the bytes removed, with n_chars to match; a document of which nothing is left goes."""
    out = dedup(docs, as_text=True).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    cut_off = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.when(cut_off, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.withColumns(new).select(*docs.columns)

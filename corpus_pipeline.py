"""A corpus pipeline of five stages over documents. It belongs to fathomry.llm.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. The last one
returns token ids in place of texts. SQL can express neither the fingerprints nor the tokens, so ORACLE_SQL is None, and
tests/llm/test_pipeline.py holds run() against a brute-force version.

Defined results: a null or empty text is rejected by the quality rules; a null id comes last where one document of a group stays,
and first where strings are judged by who had them first; of equal rows one stays; of documents with one id and different texts
each is judged by its own; a document that loses its whole text to suffix-array dedup goes; texts may be of any length; an empty
table gives an empty table; columns besides those of documents are carried to the last stage, which replaces its own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomry.llm import encode, mixing, quality, simhash, suffix_array
from fathomry.llm.common import table, written

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("suffix_array_dedup", suffix_array.stage),
    ("mixing", mixing.stage),
    ("bpe", encode.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

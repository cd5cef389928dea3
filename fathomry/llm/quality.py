"""Quality rules with host-level verdicts.

Each document gets counts, a base verdict and a verdict on further rules (symbols, repeated lines, length of words). Failures of
either are summed by host (a column such as `source`), and each host's failure rate is shrunk towards the corpus by an empirical
beta prior of bounded size. A host whose shrunk rate lies far above the prior takes its other documents with it, and a host far
below the mean is trusted: its documents are not held to the further rules. Only one row per host is ever joined back, and only
sums are sent through a shuffle.

Defined results: a null or empty text has zero counts and fails (too few words); a document with a null host is judged by
its own rules alone; equal rows get equal verdicts, and rows with equal ids their
own; a rate on a bound is within it; texts may be of any length; an empty table gives an empty table; input columns
named like an output are replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, append, raw, table, without, written

SYMBOLS = b"#*$%&|<>"
#: UTF-8 continuation bytes: what is left of a text without them has one byte for each code point.
_REST = bytes(range(0x80, 0xC0))
_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + _REST)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
    )


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def measure(docs: DataFrame, text: str = "text", *, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with the counts and base_failed."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [counts(x) for x in raw(batch.column(text))]
            return [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]

        return run

    out = without(append(docs, _FIELDS, make, text), "base_failed", "rule_failed")
    n, symbols, lines, letters = (F.col(c) for c in ("n_words", "n_symbols", "n_dup_lines", "word_chars"))
    base = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    return out.select("*", base.alias("base_failed"), ((10 * symbols > n) | (10 * lines > n) | (2 * letters < 5 * n) | (letters > 12 * n)).alias("rule_failed"))


def host_rates(measured: DataFrame, host: str = "source", *, max_rate: float = 0.8) -> DataFrame:
    """host, n, failed, rate (shrunk), host_rejected, host_trusted. The prior is Beta(m*s, (1-m)*s) with mean m and size s by moments over hosts; max_rate: a rate above which a host goes whatever the prior."""
    fails = (F.col("base_failed") | F.col("rule_failed")).cast("long")
    hosts = measured.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(fails).alias("failed"))
    hosts = written(hosts, "hosts")
    one = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q")).first()
    mean, size = prior(one["k"], one["n"], one["f"], one["q"])
    rate = (F.col("failed") + mean * size) / (F.col("n") + size)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > bound(mean, size, max_rate)).alias("host_rejected"), (rate < mean / 2).alias("host_trusted"))


def prior(k: int, n: int | None, failed: int | None, squares: float | None, most: float = 1000.0) -> tuple[float, float]:
    """Mean and size of the beta prior from k hosts; squares is the sum of failed^2 / n. The scatter of host rates about the mean, less what binomial noise explains, sets the size, which is 1 to `most`: as many documents outweigh it."""
    if not k:
        return 0.0, 1.0
    mean = failed / n
    noise = mean * (1 - mean)
    if k < 2 or noise == 0:
        return mean, 1.0
    scatter = squares - n * mean * mean
    between = (scatter - (k - 1) * noise) / n
    return mean, most if between <= noise / (most + 1) else max(1.0, noise / between - 1)


def bound(mean: float, size: float, max_rate: float) -> float:
    """Three standard deviations of the prior above its mean, twice the mean at least, max_rate at most."""
    return min(max_rate, max(2 * mean, mean + 3 * (mean * (1 - mean) / (size + 1)) ** 0.5))


def judge(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """measured with kept."""
    verdicts = hosts.where("host_rejected or host_trusted").select(F.col("host").alias("__host"), "host_rejected", "host_trusted")
    out = without(measured, "kept", "host_rejected", "host_trusted").join(verdicts, F.col(f"`{host}`") == F.col("__host"), "left")
    bad, good = (F.coalesce(c, F.lit(False)) for c in ("host_rejected", "host_trusted"))
    return out.select("*", (~F.col("base_failed") & ~bad & (good | ~F.col("rule_failed"))).alias("kept")).drop("__host", "host_rejected", "host_trusted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = written(measure(docs).drop("text"), "quality")
    return judge(rows, host_rates(rows)).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules or the verdict on the host reject. Each text is read and measured once."""
    name = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    measured = written(measure(docs.toDF(*name.values()), name["text"]), "measured")
    kept = judge(measured, host_rates(measured, name["source"]), name["source"]).where("kept")
    return kept.select(*[F.col(x).alias(c) for c, x in name.items()])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\v\f]+') AS w FROM documents
), tri AS (
  SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM tri WHERE z IS NOT NULL) WHERE c > 1
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^ \t\n\r\v\f]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(w) AS base_failed,
    10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words AS rule_failed
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN again ON d.doc_id = again.doc_id
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR rule_failed)::INT)::DOUBLE AS f FROM m WHERE source IS NOT NULL GROUP BY source
), s AS (
  SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(n) * (sum(f) / sum(n)) ** 2 AS scatter FROM h
), p AS (
  SELECT mean, CASE WHEN k < 2 OR mean * (1 - mean) = 0 THEN 1.0
    WHEN (scatter - (k - 1) * mean * (1 - mean)) / n <= mean * (1 - mean) / 1001 THEN 1000.0
    ELSE greatest(1.0, mean * (1 - mean) / ((scatter - (k - 1) * mean * (1 - mean)) / n) - 1) END AS size FROM s
), r AS (
  SELECT source, (f + mean * size) / (n + size) AS rate, mean,
    least(0.8, greatest(2 * mean, mean + 3 * sqrt(mean * (1 - mean) / (size + 1)))) AS bound FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed,
  NOT base_failed AND NOT coalesce(rate > bound, false) AND (NOT rule_failed OR coalesce(rate < mean / 2, false)) AS kept
FROM m LEFT JOIN r ON m.source = r.source
"""

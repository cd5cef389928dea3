"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line; its leaves are runs of words cut where the words themselves say so, so that an edit moves few cuts, and
every 64 characters where no word does. A section is `SECTION` paragraphs. Each node is the hash of its children's, so equal roots mean equal texts and `edits` finds
what differs by walking down only where hashes differ. Likeness is the Dice share of the leaves
two trees have in common, at their places or as sets.
A fingerprint is the root and then the leaves, in hexadecimal digits.

Only DataFrame functions are used. Defined results: a null text counts as empty; an empty text has no leaves, is like another
empty one (1.0) and unlike any other (0.0); equal rows have equal results, and among the documents in order they count once;
rows with equal ids follow one another by a hash of their texts, and null ids come first; the only document is its own next
one; texts may be of any length; an empty table gives an empty table; columns other than the id and the text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SECTION = 8
#: 14 to 63 characters, up to a space after one of these letters or marks; 64 of them where there is none, as in scripts without spaces; or the rest of the line.
LEAF = r"[^\n]{14,63}?[esnt.,;:!?#*$%&|<>-] |[^\n]{64}|[^\n]+"


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, leaves): the hashes of each layer, left to right."""
    lines = F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x)))
    return lines


def _layers(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the tree of a text column, layer by layer, as <name>_root, _sections, _paragraphs and _leaves."""
    paragraphs, sections = f"{name}_paragraphs", f"{name}_sections"
    df = df.withColumn("__lines", tree(F.col(text)))
    df = df.withColumn(paragraphs, F.transform("__lines", lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION))
    df = df.withColumn(sections, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(paragraphs), i, F.lit(SECTION)))))
    root = F.md5(F.array_join(F.transform(sections, lambda x: F.hex(x)), "").cast("binary"))
    leaves = F.transform(F.flatten("__lines"), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumns({f"{name}_root": root, f"{name}_leaves": leaves}).drop("__lines")


def trees(df: DataFrame, text: str = "text", name: str = "tree") -> DataFrame:
    """df with its texts' trees."""
    return _layers(df, text, name)


def fingerprint(name: str) -> Column:
    return F.concat(F.col(f"{name}_root"), F.lit("-"), F.array_join(F.transform(f"{name}_leaves", lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves in common, branch by branch at their places or, if that is more, as sets wherever they stand."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))
    placed = 2.0 * same / (F.size(a) + F.size(b))
    moved = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.greatest(placed, moved))


def edits(a: str, b: str) -> Column:
    """The numbers, from 0, of the paragraphs of tree a that differ in tree b at their place; only sections that differ are looked into."""
    sections = F.filter(F.sequence(F.lit(0), F.size(f"{a}_sections") - 1), lambda s: ~F.get(F.col(f"{a}_sections"), s).eqNullSafe(F.get(F.col(f"{b}_sections"), s)))
    inside = F.flatten(F.transform(sections, lambda s: F.sequence(s * SECTION, F.least(s * SECTION + SECTION, F.size(f"{a}_paragraphs")) - 1)))
    return F.filter(inside, lambda p: ~F.get(F.col(f"{a}_paragraphs"), p).eqNullSafe(F.get(F.col(f"{b}_paragraphs"), p)))


def followers(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """Each distinct (doc_id, th) with the one after it in order (the first after the last), and whether any occurs in several rows. Only ids move: range partitions, a window inside each, and one row for each partition to tie them."""
    ids = keyed.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("text")).alias("n_chars"))
    ids = written(ids.repartitionByRange("doc_id", "th").withColumn("p", F.spark_partition_id()), "order")
    here = F.struct("doc_id", "th")
    firsts = ids.groupBy("p").agg(F.min(here).alias("first"))
    # as many rows as partitions
    every = W.orderBy("p")
    nexts = firsts.select(F.col("p").alias("q"), F.coalesce(F.lead("first").over(every), F.min("first").over(W.partitionBy())).alias("first"))
    after = F.lead(here).over(W.partitionBy("p").orderBy("doc_id", "th"))
    out = ids.withColumn("after", after).join(nexts, F.col("p") == F.col("q")).withColumn("after", F.coalesce("after", "first"))
    repeated = bool(ids.agg(F.max("rows") > 1).first()[0])
    return out.select(F.col("doc_id").alias("id"), F.col("th").alias("ith"), (F.floor(F.col("n_chars") / 2)).cast("int").alias("half"), F.col("after.doc_id").alias("next_id"), F.col("after.th").alias("next_th")), repeated


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited (its last half replaced by the start of the next document) and next_leaves."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    order, repeated = followers(keyed)
    given = keyed.join(order, F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("th") == F.col("next_th")))
    given = _layers(given.select("id", "ith", "half", "text"), "text", "next").select("id", "ith", "half", F.left("text", F.col("half")).alias("head"), "next_leaves")
    if repeated:
        given = given.dropDuplicates(["id", "ith"])
    out = keyed.join(given, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("ith")))
    edited = F.concat(F.left("text", F.length("text") - F.col("half")), "head")
    return out.select("doc_id", "text", edited.alias("edited"), "next_leaves")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees(trees(with_edits(table(spark, sf_dir, "documents")), "text", "own"), "edited", "new")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("new").alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), F.col("new_leaves")).alias("near_edited"),
        likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"),
        F.size(edits("own", "new")).cast("long").alias("n_edited_paragraphs"),
    )

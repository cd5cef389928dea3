"""Two-pass external shuffle into shards.

Pass one scatters whole records by seeded hashes: a shard by the highest of the shards' hashes with the record's key, and
inside it, by a hash of the whole record, one of as many buckets as keep a bucket within `bucket_bytes`; a shard with more
bytes has more buckets, so a key with many records is dealt over many. Pass two holds one bucket at a time, permutes it by
Fisher-Yates (`shuffle` with a seed) and writes it; buckets follow one another in their shard. The key and the number of
shards alone decide the shard; with one more shard, records move only into the new one.

Only DataFrame functions are used. The order inside a bucket before its permutation is fixed by the records themselves, and
slots are counted from what was written.

Defined results: a null text has no bytes and a size of 16; a null key is hashed like a value; equal rows have slots of their
own, and more than `REPEATS` of them are dealt over the shard's buckets by their places in the input; rows with equal keys have
one shard, and slots in the order of their bucket's permutation; texts may be of any length, and a bucket holds one row at least;
an empty table gives an empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, without

OVERHEAD = 16
#: Equal rows up to which they stay in one bucket.
REPEATS = 1000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is highest."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s")))
    return F.array_max(scored)["s"]


def scatter(df: DataFrame, key: str, size: str, shards: int, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """df with shard and bucket (unique over all shards), and the number of buckets."""
    names = df.columns
    dealt = df.withColumn("shard", shard_of(F.col(key), shards, seed))
    found = {r["shard"]: r["bytes"] or 0 for r in dealt.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()}  # one row for each shard
    counts = [max(1, -(-found.get(s, 0) // bucket_bytes)) for s in range(shards)]
    record = F.xxhash64(F.lit(seed + 1), *names)
    many = df.groupBy(record.alias("__h")).count().where(F.col("count") > REPEATS).select("__h", F.lit(True).alias("__many"))
    # one row at most for each REPEATS records, so that no record is shuffled to meet it
    dealt = dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__h", record).join(F.broadcast(many), "__h", "left")
    salted = F.when(F.col("__many"), F.xxhash64("__h", "__at")).otherwise(F.col("__h"))
    first = [sum(counts[:s]) for s in range(shards)]
    n, before = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("shard")) for xs in (counts, first))
    return dealt.withColumn("bucket", before + F.pmod(salted, n)).select(*names, "shard", "bucket"), sum(counts)


def write_shards(df: DataFrame, path: str, key: str, size: str, *, shards: int, seed: int = 11, bucket_bytes: int = 8 << 20) -> None:
    """Writes the shuffled records, each shard a folder, each bucket in one file in its order. size: bytes of each record."""
    df = without(df, "shard", "slot", "bucket")
    names = df.columns
    dealt, buckets = scatter(df, key, size, shards, seed, bucket_bytes)
    tasks = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    record = F.struct(F.xxhash64(F.lit(seed + 2), *names).alias("h"), F.struct(*names).alias("r"))
    held = dealt.repartition(tasks, "bucket").groupBy("shard", "bucket").agg(F.collect_list(record).alias("rows"))
    mixed = held.select("shard", "bucket", F.shuffle(F.array_sort("rows"), F.lit(seed)).alias("rows"))
    rows = mixed.select("shard", "bucket", F.posexplode("rows").alias("at", "row")).select("row.r.*", "bucket", F.col("at").alias("slot"), "shard")
    rows.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(df: DataFrame, path: str) -> DataFrame:
    """What write_shards has made of df: its columns, shard and slot (from 0, without gaps, in each shard)."""
    schema = without(df, "shard", "slot", "bucket").schema.add("bucket", "long").add("slot", "integer").add("shard", "integer")
    rows = df.sparkSession.read.schema(schema).parquet(path)
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row for each bucket, so that no record is shuffled again
    before = sizes.select(F.col("bucket").alias("b"), F.expr("sum(n) over (partition by shard order by bucket) - n").alias("before"))
    return rows.join(F.broadcast(before), F.col("bucket") == F.col("b")).withColumn("slot", F.col("before") + F.col("slot")).select(*schema.names[:-3], "shard", "slot")


def external_shuffle(df: DataFrame, key: str, size: str, *, shards: int, seed: int = 11, bucket_bytes: int = 8 << 20) -> DataFrame:
    """df with shard and slot, read from shards written in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(df, path, key, size, shards=shards, seed=seed, bucket_bytes=bucket_bytes)
    return read_shards(df, path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD).cast("long")
    docs = table(spark, sf_dir, "documents")
    out = external_shuffle(docs.withColumn("size", size), "doc_id", "size", shards=40)
    return out.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), shard_of(F.col("doc_id"), 41, 11).alias("grown_shard"))

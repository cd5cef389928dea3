"""Connected components of a link table, by alternating star contractions.

Links never leave the executors. Each round writes its links as a table in the shared folder; a round is two grouped minima
with partial sums on the map side, so a vertex with a third of all links costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links to a file: small tables are not written, and read again in the next round, as one file for each shuffle partition.
LINKS = 100_000


def _contract(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (a, b) with a > b. Large: every larger neighbour of a vertex is tied to the least of its neighbours and itself. Small: every smaller one and the vertex itself are."""
    if large:
        both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = both.groupBy("v").agg(F.min("w").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        out = both.where("w > v").join(least, F.col("v") == F.col("k")).select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = links.join(least, F.col("a") == F.col("k"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each vertex that has links and is not the least of its component, with that least vertex. links: (a, b) with a > b."""
    links = written(links.distinct(), "links")
    before, n = None, links.count()
    while True:
        links = written(_contract(_contract(links, large=True), large=False).coalesce(1 + n // LINKS), "stars")
        # a fixed point keeps count and sums
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return links
        before, n = now, now[0]

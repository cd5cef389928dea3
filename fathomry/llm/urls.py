"""URL filters by a Bloom filter cascade.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that level 0 takes for listed though they are not,
level 2 the listed ones that level 1 takes for those, and so on until no key is left over. The keys of the corpus being all
that will ever be asked, a key is listed exactly if the first level that lacks it is an odd one. Only DataFrame functions are
used: a level is one array of longs, made by a grouped OR and asked as a scalar, so that URLs meet no join.

A cascade's size follows its list, not the corpus. A list that would need a level of more than `MOST_BITS` is cut by a hash
of the key into slices with a cascade each, so that no scalar is larger.

Rules are listed keys too: the key of a rule is its host and path as written, and a URL asks for every suffix of its host with
every prefix of its path whose length some rule has. The longest listed key wins. A URL that fits no rule is judged by its
host, which is a key of another list.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; repeated rows get equal
verdicts and stay repeated; without rules, or with an empty list, nothing is listed; of rules of equal length that fit, the
greatest string wins; urls may be of any length; an empty table gives an empty table; columns other than the id and the url are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: The longest level that may be sent about as one scalar (8 MB).
MOST_BITS = 1 << 26
#: A set of at most so many keys ends its cascade with one level that most likely lets nothing through.
LAST = 4096
#: Parts of host names that the query lists.
LISTED_WORDS = ("casino", "pills", "free-bets", "spam-farm", "ads-track", "adult")
#: The query's rules as (allow, host, path).
RULES = ((True, "org", "/"), (False, "example.org", "/es/"), (False, "example.org", "/en/1"), (True, "com", "/fr/"), (False, "com", "/de/"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url. Both are empty if it is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    number: int
    size: int
    hashes: int
    words: DataFrame | None = None  # one row: the bits as an array of longs

    def bits(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(7919 * self.number + i), key), F.lit(self.size)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        bits = keys.select(F.explode(F.array(*self.bits(F.col("key")))).alias("bit"))
        found = bits.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
        every = keys.sparkSession.range(self.size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        merged = found.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self.words = written(merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")), "bloom")
        return self

    def has(self, key: Column) -> Column:
        words = self.words.scalar()
        out = F.lit(True)
        for bit in self.bits(key):
            out &= F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 1)).otherwise(out)
        return out


def _cascade(inside: DataFrame, outside: DataFrame, n: int, rest: int) -> Cascade:
    made = Cascade()
    while n:
        number = len(made.levels)
        if number > 60:
            raise ValueError("the cascade does not end: is a key both listed and not?")
        # level 0 lets through about as many of the rest as are listed, later ones half of what they are asked
        rate = max(n * math.sqrt(0.5) / max(rest, 1), 1e-4) if not number else 1 / (4 * rest + 4) if n <= LAST else 0.5
        rate = min(rate, 0.5)
        hashes = max(1, round(-math.log2(rate)))
        size = 64 * math.ceil((-n * hashes / math.log(1 - rate ** (1 / hashes)) + 64) / 64)
        level = Level(number, size, hashes).fill(inside)
        made.levels.append(level)
        # what passes falsely is the next level's set, and what is encoded here is asked there
        inside, outside = written(outside.where(level.has(F.col("key"))), "passed"), inside
        n, rest = inside.count(), n
    return made


@dataclass
class Listing:
    """Exact membership for all keys of a universe."""

    slices: list[Cascade]

    def lists(self, key: Column) -> Column:
        out = self.slices[0].lists(key)
        for i, c in enumerate(self.slices[1:], 1):
            out = F.when(F.pmod(F.xxhash64(F.lit(-1), key), F.lit(len(self.slices))) == i, c.lists(key)).otherwise(out)
        return out


def listing(universe: DataFrame) -> Listing:
    """universe: every key that will be asked, as (key, listed), distinct and not null. It is read several times: better a written table."""
    n, rest = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    cuts = max(1, math.ceil(20 * n / MOST_BITS))
    out = []
    for i in range(cuts):
        part = universe if cuts == 1 else universe.where(F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(cuts)) == i)
        a, b = (n, rest) if cuts == 1 else part.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
        out.append(_cascade(part.where("listed").select("key"), part.where(~F.col("listed")).select("key"), a, b))
    return Listing(out)


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys a url asks for among rules: suffixes of its host by prefixes of its path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.concat(*[F.when(F.length(path) >= n, F.array(F.substring(path, 1, n))).otherwise(F.array().cast("array<string>")) for n in lengths]) if lengths else F.array().cast("array<string>")
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h))))


def filter_urls(pages: DataFrame, rules: list[tuple[bool, str, str]], hosts: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, listed_host, verdict. rules: (allow, host, path); hosts: the listed hosts, as (host)."""
    spark = pages.sparkSession
    host, path = host_and_path(url)
    asked = pages.select(page_id, url, host.alias("host"), path.alias("path"))
    asked = written(asked.withColumn("keys", rule_keys(F.col("host"), F.col("path"), sorted({len(p) for _, _, p in rules}))), "urls")
    named = spark.createDataFrame([(h + p, a) for a, h, p in rules], "key string, allow boolean")
    keys = asked.select(F.explode("keys").alias("key")).distinct()
    keys = written(keys.select("key", F.lit(False).alias("allow"), F.lit(False).alias("block")).union(named.select("key", "allow", ~F.col("allow"))).groupBy("key").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block")), "keys")
    allow, block = (listing(keys.select("key", F.col(c).alias("listed"))) for c in ("allow", "block"))
    names = asked.select(F.col("host").alias("key"), F.lit(False).alias("listed")).union(hosts.select(F.coalesce("host", F.lit("")), F.lit(True)))
    listed = listing(written(names.groupBy("key").agg(F.bool_or("listed").alias("listed")), "hosts"))

    key = F.col("key")
    one = asked.select(page_id, url, "host", "path", F.size("keys").alias("n"), F.explode_outer("keys").alias("key"))
    one = one.withColumns({"allow": F.coalesce(allow.lists(key), F.lit(False)), "block": F.coalesce(block.lists(key), F.lit(False))})
    # a key in both lists is blocked
    best = F.max(F.when(F.col("allow") | F.col("block"), F.struct(F.length("key").alias("n"), "key", "block"))).alias("best")
    judged = one.groupBy(page_id, url, "host", "path", "n").agg(best, F.count(F.lit(1)).alias("rows"))
    judged = judged.withColumn("listed_host", listed.lists(F.col("host")))
    verdict = F.when(F.coalesce("best.block", "listed_host"), "block").otherwise("allow")
    times = F.explode(F.array_repeat(F.lit(1), (F.col("rows") / F.greatest("n", F.lit(1))).cast("int"))).alias("__time")
    return judged.select(page_id, url, "host", "path", F.col("best.key").alias("rule"), "listed_host", verdict.alias("verdict"), times).drop("__time")


def hosts_with(pages: DataFrame, words: tuple[str, ...], url: str = "url") -> DataFrame:
    """The hosts of pages that contain one of the words."""
    host, _ = host_and_path(url)
    return pages.select(host.alias("host")).where(F.col("host").rlike("|".join(words))).distinct()


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, list(RULES), hosts_with(pages, LISTED_WORDS)).drop("url")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule,
    regexp_matches(host, 'casino|pills|free-bets|spam-farm|ads-track|adult') AS listed_host FROM q
)
SELECT page_id, host, path, rule, listed_host,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') OR (rule IS NULL AND listed_host) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

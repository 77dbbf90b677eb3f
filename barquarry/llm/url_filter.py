"""URL rules kept in a cascade of Bloom filters, all in DataFrame functions (operator 13).

A rule is a host and the start of a path; it fits its host and all subdomains. A URL therefore has one
candidate key for each (labels of a host, length of a path) that some rule has. All candidates
of the pages and all rules are the key universe. Level 1 of a cascade holds the listed keys, level 2 the
unlisted keys that level 1 takes for listed, level 3 the listed ones that level 2 holds by mistake, and so
on until a level errs on no key: then the number of levels that a key passes tells whether it is listed, for
every key of the universe, without a join. A second cascade over the listed keys tells which block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm.common import read, stored

#: Rules of the registered query: verdict, host, path (fixed values).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A filter sent to all tasks has at most so many bytes; more keys are parted and looked up pass by pass.
MOST_BYTES = 16 << 20
#: Candidate keys tried in one projection; more follow in further ones.
SHAPES_AT_ONCE = 48
WORD = 64
MOST_HASHES = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


@dataclass
class Level:
    """One Bloom filter: its 64-bit words (a one-row table). A key has ``hashes`` bits, all in one word."""

    words: DataFrame | None
    n_words: int
    hashes: int
    salt: int

    def word_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(2 * self.salt), key), F.lit(self.n_words))

    def mask_of(self, key: Column) -> Column:
        h = F.xxhash64(F.lit(2 * self.salt + 1), key)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(self.hashes)]
        return reduce(Column.bitwiseOR, bits)

    def passes(self, key: Column) -> Column:
        mask = self.mask_of(key)
        return F.get(self.words.scalar(), self.word_of(key).cast("int")).bitwiseAND(mask) == mask


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed; other keys get either answer. Null is not listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return key.isNotNull() & answer


def bloom(keys: DataFrame, n_words: int, hashes: int, salt: int) -> Level:
    """The filter of ``keys``: masks of one word are merged by a hash aggregate, words put in order in one array."""
    level = Level(None, n_words, hashes, salt)
    key = F.col("key")
    found = keys.groupBy(level.word_of(key).alias("id")).agg(F.bit_or(level.mask_of(key)).alias("word"))
    every = keys.sparkSession.range(n_words).join(found, "id", "left")
    rows = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w"))
    level.words = stored(rows.select(F.col("w.word").alias("words")))
    return level


def build(universe: DataFrame, salt: int = 0, most_bytes: int = MOST_BYTES, most_hashes: int = MOST_HASHES) -> Cascade:
    """A cascade that answers exactly for every row of ``universe`` (distinct key, listed boolean).

    Bits of the first level follow from the numbers of listed and unlisted keys; further levels err on every
    other key. Raises if a level would need more than ``most_bytes``.
    """
    counts = universe.agg(F.count_if("listed").alias("yes"), F.count_if(~F.col("listed")).alias("no")).first()
    sides, left = {True: counts["yes"], False: counts["no"]}, {}
    left = {side: universe.where(F.col("listed") if side else ~F.col("listed")).select("key") for side in sides}
    cascade, side = Cascade(), True
    while sides[side]:
        share = min(0.5, max(sides[True] * math.sqrt(0.5) / max(1, sides[False]), 1e-9)) if not cascade.levels else 0.5
        # Bits of one key share a word, so several need more room than if they were spread over the filter.
        hashes = min(most_hashes, max(1, round(math.log2(1 / share))))
        n_words = math.ceil(sides[side] * hashes / math.log(2) / WORD * (1 + hashes // 2 / 2))
        if WORD * n_words > 8 * most_bytes:
            raise ValueError(f"{sides[side]} keys need a filter of {n_words} words, more than {most_bytes} bytes; part the keys")
        level = bloom(left[side], n_words, hashes, salt * 1000 + len(cascade.levels))
        cascade.levels.append(level)
        # The other side's keys that pass by mistake are what the next level holds.
        side = not side
        if sides[side]:
            left[side] = stored(left[side].where(level.passes(F.col("key"))))
            sides[side] = left[side].count()
    return cascade


def normal_rules(rules: DataFrame) -> DataFrame:
    """key, blocks, labels, length of each rule; rows with a null are left out, and of contradicting rows the block counts."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
    rules = rules.select(F.concat("host", "path").alias("key"), labels_of("host").alias("labels"), F.length("path").alias("length"), (F.col("verdict") == "block").alias("blocks"))
    return rules.groupBy("key", "labels", "length").agg(F.max("blocks").alias("blocks"))


def candidates(shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape the key that ``_host`` and ``_path`` have in it, or null."""
    out = []
    for labels, length in shapes:
        there = (F.col("_labels") >= labels) & (F.length("_path") >= length)
        out.append(F.when(there, F.concat(F.substring_index("_host", ".", -labels), F.substring("_path", 1, length))))
    return out


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, url, host, path, rule, verdict of each row of ``pages``.

    ``rules`` has verdict (allow or block), host and path. A rule fits if the URL's host is the rule's or
    ends with a dot and the rule's, and its path starts with the rule's; the longest host and path
    together wins. Without a fitting rule the URL is not listed: rule is null and the verdict ``default``.
    A null or malformed URL has an empty host and path, which only a rule with an empty host could fit.
    Repeated rows are each judged, empty tables give empty results; other columns of pages are not read.
    """
    rules = stored(normal_rules(rules))
    shapes = sorted((r["labels"], r["length"]) for r in rules.select("labels", "length").distinct().collect())
    groups = [shapes[i : i + SHAPES_AT_ONCE] for i in range(0, len(shapes), SHAPES_AT_ONCE)]
    page = pages.select("page_id", "url", host_of("url").alias("_host"), path_of("url").alias("_path"))
    page = page.withColumn("_labels", labels_of("_host"))
    found = page.withColumn("_best", F.lit(None).cast("struct<size:int,key:string>"))
    blocks = F.lit(False)
    n_rules = rules.count()
    if n_rules:
        keys = reduce(DataFrame.unionAll, [page.select(F.explode(F.array(*candidates(g))).alias("key")) for g in groups])
        tagged = keys.where(F.col("key").isNotNull()).withColumn("listed", F.lit(False)).unionAll(rules.select("key", F.lit(True)))
        universe = stored(tagged.groupBy("key").agg(F.max("listed").alias("listed")))
        # A listed key takes at most 35 bits; the parts of larger lists are looked up one after the other.
        parts = -(-n_rules * 48 // (8 * most_bytes))
        part_of = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)) if parts > 1 else F.lit(0)
        for part in range(parts):
            listed = build(universe.where(part_of(F.col("key")) == part), 2 * part, most_bytes)
            blocking = build(rules.where(part_of(F.col("key")) == part).select("key", F.col("blocks").alias("listed")), 2 * part + 1, most_bytes)
            for group in groups:
                hits = [F.when((part_of(k) == part) & listed.holds(k), F.struct(F.length(k).alias("size"), k.alias("key"))) for k in candidates(group)]
                found = found.withColumn("_best", F.greatest("_best", F.lit(None).cast("struct<size:int,key:string>"), *hits))
            own = (part_of(F.col("_best.key")) == part) & blocking.holds(F.col("_best.key"))
            found = found.withColumn("_blocks", own if part == 0 else F.when(part_of(F.col("_best.key")) == part, own).otherwise(F.col("_blocks")))
            found = found if parts == 1 else stored(found)
        blocks = F.col("_blocks")
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(blocks, "block").otherwise("allow")
    return found.select("page_id", "url", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.key").alias("rule"), verdict.alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judged(read(spark, sf_dir, "pages"), rules).drop("url")


ORACLE = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rid)
"""

"""URL filter: rules first, then a Bloom filter cascade over hosts, in DataFrame functions only.

The key universe is every distinct host of the table; listed keys are those that a given table of hosts
holds. Level 0 encodes the listed keys, level 1 the other keys that level 0 takes wrongly, level 2 the listed keys
that level 1 takes wrongly, and so on until none is left. Over that universe membership is exact: the
first level that lacks a key decides. A level is a bit map of proven size in blocks: one hash picks a key's block,
another its bits there. Each level stands once in the plan, as a binary constant from which a block is cut, so pages are
judged in one scan without a join or a shuffle. A universe whose constants would exceed MOST_BITS is halved by bits of a hash of the
key until each part has a cascade of its own within MOST_BITS; there is a scan for each part, and never a join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table

#: Rules (host, path) and their verdicts; of those that fit, the longest wins.
RULES = (("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block"))
#: The query's list of hosts: those of its table with one of these labels, and those of whose pages this share in percent, and LEAST_PAGES at least, have a title with such runs of signs.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
JUNK_TITLE, JUNK_PERCENT, LEAST_PAGES = "<title>[^<]*[#%*]{3}", 3, 5
#: Bits of all levels together, 8 MiB, and the least that may be asked for.
MOST_BITS, LEAST_BITS = 1 << 26, 1 << 12
#: A block is LONGS numbers of LONG_BITS bits, of which a prime number are used; a byte of the constant holds seven bits.
LONGS, LONG_BITS, BLOCK_BITS = 7, 63, 439
#: Levels of at most so many keys take few false positives, which ends the cascade early.
SMALL, SMALL_RATE = 1000, 1 / 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. Of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def listed_by_label(host: Column, labels: tuple = LISTED_LABELS) -> Column:
    return host.rlike(r"(^|\.)(" + "|".join(map(re.escape, labels)) + r")(\.|$)")


def size_of(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of n keys."""
    return max(64, math.ceil(n * math.log2(1 / rate) / math.log(2))), max(1, round(math.log2(1 / rate)))


class Level:
    """One Bloom filter: its size is known before its bits are gathered."""

    def __init__(self, number: int, bits: int, hashes: int):
        self.number, self.blocks, self.hashes, self.constant = number, math.ceil(bits / BLOCK_BITS), hashes, b""
        self.bits = 8 * self.blocks * LONGS * LONG_BITS // 7

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(2 * self.number), key), F.lit(self.blocks))

    def places(self, key: Column) -> list[Column]:
        """The key's bits in its block, all different."""
        hashed = F.xxhash64(F.lit(2 * self.number + 1), key)
        first, step = F.pmod(hashed, F.lit(BLOCK_BITS)), F.pmod(F.shiftright(hashed, 32), F.lit(BLOCK_BITS - 1)) + 1
        return [F.pmod(first + i * step, F.lit(BLOCK_BITS)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """The bit map from all keys (key): a row of LONGS numbers for each block, at most MOST_BITS together."""
        at = keys.select(self.block(F.col("key")).alias("block"), F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        bit = lambda j: F.when(F.expr(f"at div {LONG_BITS}") == j, F.expr(f"shiftleft(1L, cast(at % {LONG_BITS} AS int))"))
        rows = at.groupBy("block").agg(*[F.coalesce(F.bit_or(bit(j)), F.lit(0)) for j in range(LONGS)]).collect()
        longs = np.zeros((self.blocks, LONGS), np.int64)
        for r in rows:
            longs[r[0]] = r[1:]
        self.constant = ((longs[:, :, None] >> np.arange(0, LONG_BITS, 7)) & 127).astype(np.uint8).tobytes()
        return self

    def judged(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """rows with a column out: whether the level has the key. The key's block is a column of its own, cut from the constant once."""
        size = LONGS * LONG_BITS // 7
        block = F.substring(F.lit(self.constant), self.block(F.col(key)).cast("int") * size + 1, F.lit(size))
        names = rows.columns
        byte = lambda at: F.ascii(F.substring(F.col("_block"), (at / 7).cast("int") + 1, F.lit(1)).cast("string"))
        hits = [F.getbit(byte(at), (at % 7).cast("int")) == 1 for at in self.places(F.col(key))]
        return rows.withColumn("_block", block).select(*names, reduce(Column.__and__, hits).alias(out))


class Cascade:
    """Levels over a universe of (key, listed); exact for its keys."""

    def __init__(self, universe: DataFrame, most_bits: int = MOST_BITS):
        n = universe.agg(F.count_if("listed").alias("listed"), F.count("*").alias("all")).first()
        self.levels: list[Level] = []
        self.fits, self.bits = True, 0
        inside, outside, k = universe.filter("listed").select("key"), universe.filter("not listed").select("key"), n.listed
        rate = min(0.5, max(n.listed, 1) / (math.sqrt(2) * max(1, n["all"] - n.listed)))
        if k > SMALL and sum(self.expected(n.listed, n["all"], rate)) > most_bits:
            self.fits = False
            return
        while k:
            level = Level(len(self.levels), *size_of(k, min(rate, SMALL_RATE) if k <= SMALL else rate))
            self.bits += level.bits
            if self.bits > most_bits:
                self.fits = False
                return
            self.levels.append(level.fill(inside))
            inside, outside = level.judged(outside, "key", "_hit").filter("_hit").select("key"), inside
            k, rate = inside.count(), 0.5

    @staticmethod
    def expected(listed: int, of_all: int, rate: float) -> Iterator[float]:
        """Bits of each level by what is expected to pass the one before, until few keys are left."""
        inside, outside = float(listed), float(of_all - listed)
        while inside > SMALL:
            yield size_of(round(inside), rate)[0]
            inside, outside, rate = outside * rate, inside, 0.5

    def judged(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """rows with a column out: whether the key, one of the universe, is listed. A null or unknown key gives any answer."""
        names = rows.columns
        found = F.lit(len(self.levels) % 2 == 1)
        for i, level in enumerate(self.levels):
            rows = level.judged(rows, key, f"_level{i}")
        for i in range(len(self.levels) - 1, -1, -1):
            found = F.when(F.col(f"_level{i}"), found).otherwise(F.lit(i % 2 == 1))
        return rows.select(*names, found.alias(out))


def judged_in_parts(rows: DataFrame, key: str, out: str, universe: DataFrame, most_bits: int = MOST_BITS, halvings: int = 0) -> DataFrame:
    """rows with a column out: whether the key is listed in universe (key, listed), by one cascade where that takes most_bits at most.

    Beyond it keys are halved by the next bit of a hash, and either half goes the same way. Each part is written before the next one is
    built, so no plan and no task holds the constants of two. Keys of one hash in all 64 bits can't be halved and raise.
    """
    cascade = Cascade(universe, max(most_bits, LEAST_BITS))  # counts first: a list that cannot fit builds no level
    if cascade.fits:
        whole = cascade.judged(rows, key, out)
        return materialise(whole, "judged") if halvings else whole
    if halvings == 64:
        raise ValueError("keys of one hash exceed a cascade")
    half = lambda c, bit: F.getbit(F.xxhash64(F.lit(-1), F.col(c)), F.lit(halvings)) == bit
    parts = [judged_in_parts(rows.filter(half(key, b)), key, out, universe.filter(half("key", b)), most_bits, halvings + 1) for b in (0, 1)]
    return parts[0].union(parts[1])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    The rule's verdict, else block for a host that the table listed (host) holds and allow for any other. Listed hosts that no
    page has, and null or repeated ones, change nothing; an empty list allows all. A null url or one
    without :// has an empty host and path, fits no rule and is allowed unless the empty host is listed. Long urls are read whole;
    repeated rows give repeated rows; an empty table gives none; other columns of pages are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    both = rows.groupBy(F.col("host").alias("key")).agg(F.lit(False).alias("own")).union(listed.select(F.col("host"), F.lit(True)).filter("host is not null"))
    universe = both.groupBy("key").agg(F.bool_or("own").alias("listed"), F.bool_or(~F.col("own")).alias("met")).filter("met").select("key", "listed")
    universe = materialise(universe, "hosts")
    rows = judged_in_parts(rows, "host", "listed", universe, most_bits)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def hosts_by_label(pages: DataFrame, labels: tuple = LISTED_LABELS) -> DataFrame:
    """A list (host): the hosts of pages with a label of these. For a real list, read its table instead."""
    host = host_and_path(F.col("url"))[0]
    return pages.select(host.alias("host")).filter(listed_by_label(F.col("host"), labels)).distinct()


def hosts_by_titles(pages: DataFrame, pattern: str = JUNK_TITLE, percent: int = JUNK_PERCENT, least: int = LEAST_PAGES) -> DataFrame:
    """A list (host): the hosts of so many pages (url, html) of which this percentage at least has html that matches. A null html matches nothing."""
    own = pages.select(host_and_path(F.col("url"))[0].alias("host"), F.coalesce(F.col("html").rlike(pattern), F.lit(False)).alias("junk"))
    return own.groupBy("host").agg(F.count("*").alias("n"), F.count_if("junk").alias("k")).filter((F.col("n") >= least) & (100 * F.col("k") >= percent * F.col("n"))).select("host")


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, hosts_by_label(pages).union(hosts_by_titles(pages)))


ORACLE = f"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html
    FROM pages
), titles AS (
    SELECT host FROM parts GROUP BY host HAVING count(*) >= {LEAST_PAGES} AND 100 * coalesce(sum(regexp_matches(html, '{JUNK_TITLE}')::INT), 0) >= {JUNK_PERCENT} * count(*)
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule,
    regexp_matches(host, '(^|\\.)({"|".join(LISTED_LABELS)})(\\.|$)') OR host IN (SELECT host FROM titles) AS listed
    FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM ruled
"""

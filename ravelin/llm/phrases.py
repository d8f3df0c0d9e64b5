"""Phrase collocations by suffix sorting (Suffix-sigma).

Every word occurrence begins a suffix of its piece, cut after max_n words. Tasks count equal suffixes before anything is shuffled. Suffixes
go to tasks by language and first word, and those of a word are sorted reverse-lexicographically, so that all that begin alike stand together, and one stack of
open prefixes, a running count for each number of words, counts every phrase in one pass.

The words that begin 1/(4 * parts) of all suffixes or more are known from a first count; there are 4 * parts of them at most. Behind such a
hot word the next word deals the suffix too, behind two hot words the third, and so on, so no task gets a larger share of one
prefix. A phrase all of whose words are hot is counted in parts, which are summed; any other is whole in one task, which drops it at once
if it is rare. Afterwards phrases are joined with the parts they can be cut into.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table

MAX_N, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one around it has this share of its occurrences, in percent.
ABSORBED = 50
SCALE = 1_000_000
#: Languages of null.
UNKNOWN = "und"
#: What ends a piece stands as STOP, which no word holds. MARK, which no word holds either, stands behind each word of a suffix, so those that begin alike are neighbours.
STOP, MARK = b".", b"\t"
ENDS = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d", STOP * 9)
#: Bytes of text of a language that a task counts at a time, and suffixes of a task of the sort.
CHUNK_BYTES, ROWS_PER_TASK = 4 << 20, 20_000_000
#: Parts that a language's best phrases are ranked in before they meet.
RANK_PARTS = 64


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of the texts of a language one after the other, lower-cased, with STOP where a piece ends; longer texts are cut there."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text, since = text.lower().translate(ENDS), 0
            while since < len(text):
                until = text.find(STOP, since + CHUNK_BYTES) % (len(text) + 1)
                held.setdefault(lang, []).append(text[since:until])
                size[lang] += until - since
                since = until
                if size[lang] >= CHUNK_BYTES:
                    yield lang, STOP.join(held.pop(lang))
                    del size[lang]
            if sum(size.values()) > 4 * CHUNK_BYTES:
                yield from ((lang, STOP.join(own)) for lang, own in held.items())
                held, size = {}, Counter()
    yield from ((lang, STOP.join(own)) for lang, own in held.items())


def numbered(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and for each word its place among them, from 1 on; 0 where a piece ends."""
    tokens = pa.array(text.replace(STOP, b" . ").split(), pa.binary()).dictionary_encode()
    stop = pc.index(tokens.dictionary, pa.scalar(STOP, pa.binary())).as_py()
    words = tokens.dictionary.filter(pc.not_equal(tokens.dictionary, pa.scalar(STOP, pa.binary())))
    place = np.arange(1, len(tokens.dictionary) + 1)
    if stop >= 0:
        place[stop:] -= 1
        place[stop] = 0
    return words, place[tokens.indices.to_numpy()]


def _rows(lang: str, keys: pa.Array, counts: np.ndarray, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from pa.table({"lang": pa.array([lang] * len(keys), pa.string()), "key": keys, "n": pa.array(counts, pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in more.items()}}).to_batches(50_000)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """Stored (lang, key, n) of the words of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches):
            words, places = numbered(text)
            yield from _rows(lang, words, np.bincount(places, minlength=len(words) + 1)[1:])

    rows = _texts(docs).mapInArrow(run, "lang string, key binary, n long")
    return materialise(rows.groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")


def distinct_suffixes(places: np.ndarray, n_words: int, max_n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of the distinct suffixes, an array for each of max_n words, 0 behind the last one; and how often each occurs."""
    start = np.flatnonzero(places)
    padded = np.concatenate((places, np.zeros(max_n, places.dtype)))
    words = [padded[start]]
    for k in range(1, max_n):
        words.append(np.where(words[-1] > 0, padded[start + k], 0))
    base = n_words + 1
    if base**max_n < 2**63:  # a suffix is one number
        code = words[0]
        for w in words[1:]:
            code = code * base + w
        code, counts = np.unique(code, return_counts=True)
        return [code // base**k % base for k in range(max_n - 1, -1, -1)], counts
    some, counts = np.unique(np.stack(words), axis=1, return_counts=True)
    return list(some), counts


def suffixes(docs: DataFrame, max_n: int, hot: Broadcast) -> DataFrame:
    """(lang, key, n, deal) of the suffixes, cut after max_n words, of all pieces of docs (lang, text); equal ones of a chunk are summed.

    deal is a hash of the words that deal a suffix: of the first one, and behind hot ones of the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for lang, text in chunks(batches):
            distinct, places = numbered(text)
            words, counts = distinct_suffixes(places, len(distinct), max_n)
            names = distinct.to_pylist()
            code, is_hot = np.array([0, *map(crc32, names)], np.int64), np.array([False, *((lang, w) in known for w in names)])
            deal, more = code[words[0]], is_hot[words[0]]
            for w in words[1:]:
                deal, more = np.where(more, deal * 1_000_003 + code[w], deal), more & is_hot[w]
            length = sum((w > 0).astype(np.int8) for w in words)
            for n in range(1, max_n + 1):
                at = np.flatnonzero(length == n)
                keys = pc.binary_join_element_wise(*(distinct.take(pa.array(w[at] - 1)) for w in words[:n]), pa.scalar(b"", pa.binary()), pa.scalar(MARK, pa.binary()))
                yield from _rows(lang, keys, counts[at], deal=deal[at])

    return _texts(docs).mapInArrow(run, "lang string, key binary, n long, deal long")


class Stack:
    """The open prefixes of a sorted run of suffixes: for each number of words the language, the phrase and its count so far.

    Suffixes are pushed in batches, for the speed of arrays; what remains open is carried to the next batch.
    """

    def __init__(self, max_n: int, least: int, hot: frozenset):
        self.least, self.hot = least, pa.array([lang.encode() + MARK + w for lang, w in hot], pa.binary())
        self.open: list[tuple[str, bytes, int]] = [("", b"", 0)] * max_n

    def in_parts(self, lang: pa.Array, words: pa.Array) -> np.ndarray:
        """Which words are hot in their language."""
        return pc.is_in(pc.binary_join_element_wise(lang.cast(pa.binary()), words, pa.scalar(MARK, pa.binary())), value_set=self.hot).to_numpy(zero_copy_only=False)

    def push(self, lang: pa.Array, keys: pa.Array, counts: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Takes the next suffixes; gives (lang, phrase, count) of the phrases that have ended, are frequent, or are counted in parts."""
        words = pc.split_pattern(keys, MARK.decode())  # and nothing behind the last mark
        length, starts, flat = pc.list_value_length(words).to_numpy() - 1, words.offsets.to_numpy()[:-1], words.flatten()
        same = pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)).to_numpy(zero_copy_only=False)
        hot = np.ones(len(keys), bool)
        for depth in range(len(self.open)):
            has = length > depth
            word = flat.take(pa.array(np.where(has, starts + depth, starts)))
            same = same & has[1:] & has[:-1] & pc.equal(word.slice(1), word.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(has & np.append(True, ~same))
            if hot.any():
                hot &= has & self.in_parts(lang, word)
            sums = np.add.reduceat(np.where(has, counts, 0), first) if len(first) else np.zeros(0, np.int64)
            phrase = lambda at, n=depth + 1: pc.binary_join(pc.list_slice(words.take(pa.array(at)), 0, n), b" ")
            yield from self.moved(depth, lang, phrase, first, sums, hot, bool(has[-1]))

    def moved(self, depth: int, lang: pa.Array, phrase: Callable, first: np.ndarray, sums: np.ndarray, hot: np.ndarray, stays: bool) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """The open phrase goes on in the first one, or ends; the last one stays open, if the run still holds it. Others are spelled only if they are given."""
        if len(first) and first[0] == 0 and self.open[depth][2] and (lang[0].as_py(), phrase(first[:1])[0].as_py()) == self.open[depth][:2]:
            sums[0] += self.open[depth][2]
        else:
            yield from self.ended(depth)
        self.open[depth] = (lang[int(first[-1])].as_py(), phrase(first[-1:])[0].as_py(), int(sums[-1])) if stays else ("", b"", 0)
        over = len(first) - stays
        at = np.flatnonzero((sums[:over] >= self.least) | hot[first[:over]])
        if len(at):
            yield lang.take(pa.array(first[at])), phrase(first[at]), sums[at]

    def ended(self, depth: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        lang, phrase, n = self.open[depth]
        words = pa.array(phrase.split(b" "), pa.binary())
        if n and (n >= self.least or self.in_parts(pa.array([lang] * len(words)), words).all()):
            yield pa.array([lang]), pa.array([phrase], pa.binary()), np.array([n])
        self.open[depth] = ("", b"", 0)

    def drained(self) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        for depth in range(len(self.open)):
            yield from self.ended(depth)


def _scanned(batches: Iterator[pa.RecordBatch], stack: Stack) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of the phrases in rows (lang, key, n) sorted so that suffixes that begin alike are neighbours."""
    for batch in batches:
        if batch.num_rows:
            for lang, phrase, n in stack.push(batch.column("lang"), batch.column("key"), batch.column("n").to_numpy()):
                yield pa.RecordBatch.from_pydict({"lang": lang, "key": phrase, "n": pa.array(n, pa.int64())})
    for lang, phrase, n in stack.drained():
        yield pa.RecordBatch.from_pydict({"lang": lang, "key": phrase, "n": pa.array(n, pa.int64())})


def frequencies(docs: DataFrame, words: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """Stored (lang, phrase, size, f) of all phrases of 1 to max_n words with `least` occurrences or more in docs (lang, text), whose words are counted."""
    spark = docs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ROWS_PER_TASK))
    begin = words.filter(F.col("n") >= max(1, total // (4 * parts))).select("lang", "key").collect()  # 8 * parts at most
    hot = spark.sparkContext.broadcast(frozenset((r.lang, bytes(r.key)) for r in begin))
    # words that deal are told apart by a number first, so most comparisons of the sort are of numbers
    runs = suffixes(docs, max_n, hot).repartition(parts, "lang", "deal").sortWithinPartitions("deal", "lang", F.desc("key")).select("lang", "key", "n")
    found = runs.mapInArrow(lambda batches: _scanned(batches, Stack(max_n, least, hot.value)), "lang string, key binary, n long")
    summed = found.groupBy("lang", F.col("key").cast("string").alias("phrase")).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return materialise(summed.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "phrases")


def part(first: Column, words: Column) -> Column:
    """Words of the phrase from first (0: the first one) on."""
    return F.concat_ws(" ", F.slice(F.split("phrase", " "), first + 1, words))


def unabsorbed(phrases: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, size, a) of the phrases (lang, phrase, size, f) of two words or more that stand in no longer one with `absorbed` percent of their occurrences."""
    own = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(0), F.col("size") - n), lambda k: part(k, n))))
    around = own.filter("size > 2").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_phrase"), "a").groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    both = own.join(around, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    return both.filter(F.col("_most").isNull() | (100 * F.col("_most") < absorbed * F.col("a"))).select("lang", "phrase", "size", "a")


def scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): of the ways to cut a candidate in two the one of the lowest score, the first of equal ones.

    Numbers are decimals of 38 digits, exact up to 10**16 occurrences; beyond that it raises.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(0), k).alias("left"), part(k, F.col("size") - k).alias("right")))
    rows = candidates.select("lang", "phrase", "a", F.inline(cuts))
    of = lambda name, n: phrases.select(F.col("lang").alias(f"_{n}lang"), F.col("phrase").alias(name), F.col("f").alias(n))
    rows = rows.join(of("_left", "l"), (F.col("lang") == F.col("_llang")) & (F.col("left") == F.col("_left"))).join(of("_right", "r"), (F.col("lang") == F.col("_rlang")) & (F.col("right") == F.col("_right")))
    exact = f"CAST(CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    return rows.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP) -> DataFrame:
    """Per language the first `top` phrases of 2 to max_n words of docs (lang, text): lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z and parted by spaces and tabs, pieces by . , ; : ! ? and line ends. a occurrences of the phrase, l and r of the
    parts of its worst cut, n of all words. Ordered by score, then a, both descending, then phrase by its bytes. A null lang is UNKNOWN; null, empty and
    blank texts have no words; long texts are read whole; repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    words = word_counts(docs)
    phrases = frequencies(docs, words, max_n, least)
    rows = scored(unabsorbed(phrases, absorbed), phrases)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    some = ranked(rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))), "lang", "_part")  # so a task gets RANK_PARTS * top rows of a language at most
    of_lang = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    return ranked(some, "lang").join(of_lang, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words
), phrases AS (
    SELECT lang, size, w[s : s + size - 1] AS p, count(*) AS f FROM (SELECT lang, w, s, unnest(range(1, {MAX_N} + 1)) AS size FROM starts) WHERE s + size - 1 <= len(w) GROUP BY ALL
), candidates AS (
    SELECT * FROM phrases WHERE size > 1 AND f >= {LEAST}
), kept AS (
    SELECT lang, size, p, f AS a FROM candidates c
    WHERE NOT EXISTS (SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.f >= {ABSORBED} * c.f AND (o.p[1:2] = c.p OR o.p[2:3] = c.p))
), cuts AS (
    SELECT k.lang, k.p, a, l.size AS place, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM kept k JOIN phrases l ON l.lang = k.lang AND l.size < k.size AND l.p = k.p[:l.size] JOIN phrases r ON r.lang = k.lang AND r.size = k.size - l.size AND r.p = k.p[l.size + 1:]
), worst AS (
    SELECT *, array_to_string(p, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, place) = 1
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE size = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""

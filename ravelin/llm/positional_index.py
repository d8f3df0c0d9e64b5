"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Documents are split into words once, and the postings (term, document, position) of the terms that the test set has are stored in the
shared folder. Every file is a segment, the inverted index of its own documents, sorted by term, so that nothing is shuffled to build it
and a common term is spread over all segments. The empty term stands behind each document's last word, so its postings are the lengths.

A window is looked up from its rarest term: the postings of that term are the candidates; those of the second rarest, moved by the
difference of their offsets, are intersected with them; what is left meets the other terms of the window in the same way, by joins on document, term
and place. Terms meet where they stand within SLOP words of the rarest one, which gives proximity matches, and exact phrases are
those whose every term stands at its own offset. Before each join the postings are cut down, in the tasks that read them, by a Bloom
filter of what is asked for, a constant of MOST_BITS at most, so the lists of other terms and places are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table
from ravelin.llm.url_cascade import MOST_BITS, Level, size_of

WINDOW = 10
#: Words to either side of the rarest one that a proximity match may use.
SLOP = 15
#: What is between words; A-Z are lower-cased word by word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term behind the last word of every document.
END = ""
#: Postings that pass a Bloom filter without being asked for.
RATE = 1 / 16


def lowered(word: Column) -> Column:
    """A-Z in lower case, and no other letters: words of ASCII go the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def split(text: Column) -> Column:
    """Words of a whole text, not yet lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def test_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(id, words) of the distinct windows of items (item_id, text), and (id, item) of the items that have them.

    A window is `size` consecutive words; an item of fewer, but not none, is one window. Null and empty texts have none; a null item_id
    is the item of the empty string; repeated items are one; other columns are ignored.
    """
    words = F.transform(split(F.col("text")), lowered)
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("_all")).filter("size(_all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_all") - size + 1, F.lit(1)))
    pairs = own.select("item", F.explode(F.transform(starts, lambda s: F.slice("_all", s, size))).alias("words")).distinct()
    windows = materialise(pairs.select("words").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    return windows, materialise(pairs.join(windows, "words").select("id", "item"), "window-items")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, uid, pos, doc_id) of the words of docs (doc_id, text) that terms (term, distinct) hold; uid numbers the rows.

    The posting of END is the number of words, and it alone carries the doc_id. Null and empty texts have that posting only; long texts are
    read whole; repeated rows are documents of their own; other columns are ignored.
    """
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.concat(split(F.col("text")), F.array(F.lit(END))).alias("_words"))
    tokens = own.select("doc_id", "uid", F.posexplode("_words").alias("pos", "term"))
    postings = tokens.select(lowered(F.col("term")).alias("term"), "uid", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"))
    return materialise(postings.join(terms, "term", "left_semi").sortWithinPartitions("term"), "postings")


def among(postings: DataFrame, key: Column, asked: DataFrame) -> DataFrame:
    """Postings whose key is in asked (key), and a share of the others, RATE while the constant has room: what joins them tells."""
    bits, hashes = size_of(max(asked.count(), 1), RATE)
    level = Level(0, min(bits, MOST_BITS), hashes).fill(asked)
    return level.judged(postings.withColumn("_key", key), "_key", "_asked").filter("_asked").drop("_key", "_asked")


def near(candidates: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Rows of candidates (uid, term, at) with pos, once for each of the term's postings in the document within slop words of at."""
    width = slop + 1
    there = postings.select(F.col("uid").alias("_uid"), F.col("term").alias("_term"), "pos", F.explode(F.array(*[F.expr(f"pos div {width}") + k for k in (-1, 0, 1)])).alias("_place"))
    place = F.expr(f"at div {width}")
    return candidates.join(there, (F.col("uid") == F.col("_uid")) & (F.col("term") == F.col("_term")) & (place == F.col("_place"))).filter(F.abs(F.col("pos") - F.col("at")) <= slop).drop("_uid", "_term", "_place")


def matches(postings: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """(id, uid, at, start, length, phrase): where windows (id, words) match documents of an index.

    Each row is a proximity match: at is a place of the window's rarest word, and every other word of the window stands within slop words of
    it, in any order. The rarest word has the fewest postings; of equal ones it is the least, at its first offset. phrase: all words stand in their
    order without a gap, from start on. slop must be as wide as a window at least, so that no phrase is missed. Windows with a word that the index
    lacks match nothing; an empty index or no windows give no rows.
    """
    frequency = postings.filter(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    terms = windows.select("id", F.size("words").alias("length"), F.posexplode("words").alias("off", "term"))
    met = terms.join(frequency, "term").groupBy("id", "length").agg(F.sort_array(F.collect_list(F.struct("n", "term", "off"))).alias("by"))  # as many as a window has words
    asked = materialise(met.filter(F.size("by") == F.col("length")), "asked")
    by = lambda k, c: F.get("by", F.lit(k))[c]
    of_rank = lambda k: among(postings, F.col("term"), asked.select(by(k, "term").alias("key")).filter("key is not null").distinct())
    first = asked.select("id", "length", by(0, "term").alias("term"), by(0, "off").alias("off"), by(1, "term").alias("second"), (by(1, "off") - by(0, "off")).alias("apart"))
    found = materialise(first.join(of_rank(0).select("term", "uid", F.col("pos").alias("at")), "term").select("id", "uid", "at", "length", "off", F.col("second").alias("term"), "apart"), "candidates")
    alone = found.filter("length = 1").select("id", "uid", "at", (F.col("at") - F.col("off")).alias("start"), "length", F.lit(True).alias("phrase"))
    key = ["id", "uid", "at", "length", "off"]
    two = near(found.filter("length > 1"), of_rank(1), slop).groupBy(*key).agg(F.bool_or(F.col("pos") - F.col("at") == F.col("apart")).alias("phrase"))
    two = materialise(two, "intersected")
    done = two.filter("length = 2").select("id", "uid", "at", (F.col("at") - F.col("off")).alias("start"), "length", "phrase")
    left = two.filter("length > 2").join(asked.select("id", F.slice("by", F.lit(3), F.greatest(F.size("by"), F.lit(1))).alias("rest")), "id").select(*key, "phrase", F.explode("rest").alias("word"))
    left = left.select(*key, "phrase", F.col("word.term").alias("term"), F.col("word.off").alias("other"))
    place = lambda c: F.expr(f"{c} div {slop + 1}")
    around = two.select("uid", F.explode(F.array(*[place("at") + k for k in (-1, 0, 1)])).alias("place")).select(F.xxhash64("uid", "place").alias("key")).distinct()
    others = among(postings.filter(F.col("term") != END), F.xxhash64("uid", place("pos")), around)
    met = near(left, others, slop).groupBy(*key, "phrase", "other").agg(F.bool_or(F.col("pos") - F.col("at") == F.col("other") - F.col("off")).alias("exact"))
    whole = met.groupBy(*key, "phrase").agg(F.count("*").alias("n"), F.bool_and("exact").alias("exact")).filter("n = length - 2")
    more = whole.select("id", "uid", "at", (F.col("at") - F.col("off")).alias("start"), "length", (F.col("phrase") & F.col("exact")).alias("phrase"))
    return materialise(alone.union(done).union(more), "matches")


def covered(spans: Column) -> Column:
    """Places in the union of spans, an ascending array of (start, stop)."""
    step = lambda done, s: F.struct((done.n + F.greatest(s.stop - F.greatest(s.start, done.reach), F.lit(0))).alias("n"), F.greatest(s.stop, done.reach).alias("reach"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), step, lambda done: done.n)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, items (ids of those with an exact window in it, sorted), near_items (with a proximity match), contaminated.

    Words are runs of letters, digits and anything beyond ASCII, A-Z lower-cased. A word inside any occurrence of a window of items
    (item_id, text) is hit. Null and empty texts have no words; those of items no windows; a null item_id is the empty string; ids of
    documents may be null or repeat; long texts are read whole; an empty table of documents gives no rows, one of items no hits; other columns are ignored.
    """
    windows, of_item = test_windows(items, size)
    terms = windows.select(F.explode("words").alias("term")).union(windows.sparkSession.range(1).select(F.lit(END))).distinct()
    postings = index(docs, materialise(terms, "terms"))
    found = matches(postings, windows, max(slop, size))
    spans = found.filter("phrase").groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))  # as many as the document has words, at most
    hit = spans.select(F.col("uid").alias("_hit"), covered(F.col("spans")).cast("long").alias("n_hit"))
    named = found.groupBy("id", "uid").agg(F.bool_or("phrase").alias("phrase")).join(of_item, "id").groupBy("uid", "item").agg(F.bool_or("phrase").alias("phrase"))
    listed = named.groupBy(F.col("uid").alias("_near")).agg(F.sort_array(F.collect_list(F.when(F.col("phrase"), F.col("item")))).alias("items"), F.sort_array(F.collect_list("item")).alias("near_items"))
    none = F.array().cast("array<string>")
    ends = postings.filter(F.col("term") == END).select("doc_id", "uid", F.col("pos").cast("long").alias("n_words"))
    both = ends.join(hit, F.col("uid") == F.col("_hit"), "left").join(listed, F.col("uid") == F.col("_near"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), (n_hit > 0).alias("contaminated"))


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_sha256"),
    )


ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS w FROM documents
), tests AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, w[s : s + {WINDOW - 1}] AS words FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM tests WHERE len(w) > 0)
), tokens AS (
    SELECT uid, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM docs
), frequency AS (
    SELECT term, count(*) AS n FROM tokens GROUP BY term
), ranked AS (
    SELECT words, off, f.term FROM (SELECT words, unnest(words) AS term, unnest(range(len(words))) AS off FROM (SELECT DISTINCT words FROM windows)) t JOIN frequency f USING (term)
    QUALIFY row_number() OVER (PARTITION BY words ORDER BY n, term, off) = 1
), candidates AS (
    SELECT words, uid, pos, off, w FROM ranked JOIN tokens USING (term) JOIN docs USING (uid)
), matched AS (
    SELECT words, uid, pos - off AS start, pos > off AND w[pos - off : pos - off + len(words) - 1] = words AS phrase FROM candidates WHERE list_has_all(w[greatest(pos - {SLOP}, 1) : pos + {SLOP}], words)
), hit AS (
    SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(range(start, start + len(words))) AS place FROM matched WHERE phrase) GROUP BY uid
), listed AS (
    SELECT uid, count(DISTINCT item) FILTER (phrase) AS n_items, count(DISTINCT item) AS n_near, coalesce(string_agg(DISTINCT item, ',' ORDER BY item) FILTER (phrase), '') AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS near
    FROM matched JOIN windows USING (words) GROUP BY uid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM docs LEFT JOIN hit USING (uid) LEFT JOIN listed USING (uid)
"""

"""Filter interaction audit by a trie of permutations.

Every order of the filters is a path from the root of a trie. What is left after a prefix depends on the set of its filters alone, so
prefixes of one set share a state: n filters have n! orders, yet 2**n states. The trie is walked depth-first: the survivors of a state
are a persisted DataFrame, cut from those of its parent by one filter; they count what each remaining filter really removes, for every
part, and are let go when the last state below them is done, so at most n DataFrames are held at a time. A state that another order has
reached is not visited again. The counts of all edges go to a table in the shared folder, from which the orders are read off by joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ravelin.llm.common import materialise, shared_dir, table

#: Filters at most: their orders are broadcast, n * n! rows of some 40 bytes.
MOST_FILTERS = 7
WORDS = "[\\x20\\x09-\\x0D]+"
SIGNS = "[#$%&*|]"
LETTERS = "ABCDE"


class Trie:
    """Counts of the edges of the permutation trie over rows (part, one boolean column for each filter: true if it fails, one for each loss)."""

    def __init__(self, rows: DataFrame, filters: Sequence[str], losses: Sequence[str]):
        self.filters, self.losses, self.seen = filters, losses, set()
        self.path = f"{shared_dir(rows.sparkSession)}/ravelin/edges-{uuid.uuid4().hex}"
        self.visit(0, rows)

    def visit(self, state: int, survivors: DataFrame) -> None:
        """Counts the edges that leave a state, then those of every state below it that is still unknown. state has a bit for each filter applied."""
        self.seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [k for k in range(len(self.filters)) if not state >> k & 1]
        self.counted(survivors, left).withColumn("state", F.lit(state)).write.mode("append").parquet(self.path)
        for k in left:
            child = state | 1 << k
            if child not in self.seen and child + 1 < 1 << len(self.filters):
                self.visit(child, survivors.filter(~F.col(self.filters[k])))
        survivors.unpersist()

    def counted(self, survivors: DataFrame, left: list[int]) -> DataFrame:
        """(part, filter, kept, removed, and a count for each loss): a row for each remaining filter; parts without survivors have none."""
        fails = lambda k: F.col(self.filters[k])
        sums = [F.count_if(fails(k)).alias(f"r{k}") for k in left] + [F.count_if(fails(k) & F.col(x)).alias(f"r{k}_{i}") for k in left for i, x in enumerate(self.losses)]
        by_part = survivors.groupBy("part").agg(F.count("*").alias("n"), *sums)
        edge = lambda k: F.struct(F.lit(self.filters[k]).alias("filter"), (F.col("n") - F.col(f"r{k}")).alias("kept"), F.col(f"r{k}").alias("removed"), *[F.col(f"r{k}_{i}").alias(f"{x}_lost") for i, x in enumerate(self.losses)])
        return by_part.select("part", F.inline(F.array(*map(edge, left))))


def orders(spark: SparkSession, filters: Sequence[str]) -> DataFrame:
    """(k, filter_order, step, filter, state): every step of every order; state has the filters applied before it."""
    rows = []
    for order in permutations(range(len(filters))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append((len(rows), "".join(filters[i] for i in order), step, filters[f], state))
            state |= 1 << f
    return spark.createDataFrame(rows, "k int, filter_order string, step int, filter string, state int")


def audit(rows: DataFrame, filters: Sequence[str], losses: Sequence[str] = ()) -> DataFrame:
    """Per part, order of the filters and step: filter, kept, removed, redundant, unique_fails, <loss>_lost for each loss, shapley.

    rows have a column part (a null one is a part of its own), a boolean column for each filter, true if the row fails it, and one for each
    loss, true if it would be a loss to remove the row; null is false, and the names of filters and losses differ from those of the result. kept and removed are
    of this step, redundant are rows that fail its filter and are gone already, unique_fails those that fail no other one, shapley is what the
    filter removes in all orders together. Counts that are zero have rows too. Repeated rows count each; other columns are ignored;
    an empty table gives no rows; more than MOST_FILTERS filters raise.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    spark, n = rows.sparkSession, len(filters)
    own = materialise(rows.select("part", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *losses)]), "verdicts")
    edges = spark.read.parquet(Trie(own, filters, losses).path)
    alone = lambda f: reduce(Column.__and__, [~F.col(x) for x in filters if x != f], F.col(f))
    sums = own.groupBy("part").agg(*[F.count_if(F.col(f)).alias(f"f{k}") for k, f in enumerate(filters)], *[F.count_if(alone(f)).alias(f"u{k}") for k, f in enumerate(filters)])
    totals = sums.select("part", F.inline(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"f{k}").alias("fails"), F.col(f"u{k}").alias("unique_fails")) for k, f in enumerate(filters)])))
    weight = F.array(*[F.lit(factorial(d) * factorial(n - 1 - d)) for d in range(n)])  # orders that pass an edge, by the filters before it
    shapley = edges.groupBy(F.col("part").alias("_p"), F.col("filter").alias("_f")).agg(F.sum(F.col("removed") * F.get(weight, F.bit_count("state"))).alias("shapley"))
    of_filter = totals.join(shapley, totals.part.eqNullSafe(F.col("_p")) & (totals["filter"] == F.col("_f"))).drop("_p", "_f")
    steps = of_filter.join(F.broadcast(orders(spark, filters)), "filter")
    known = edges.select(F.col("part").alias("_p"), F.col("filter").alias("_f"), F.col("state").alias("_s"), "kept", "removed", *[f"{x}_lost" for x in losses])
    met = steps.join(known, steps.part.eqNullSafe(F.col("_p")) & (steps["filter"] == F.col("_f")) & (steps.state == F.col("_s")), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(
        "part", "filter_order", "step", "filter", count("kept").alias("kept"), count("removed").alias("removed"), (F.col("fails") - count("removed")).alias("redundant"), "unique_fails", *[count(f"{x}_lost").alias(f"{x}_lost") for x in losses], "shapley"
    )


def document_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): part, the five failure conditions A to E, good, toxic.

    A: under 100 words; B: under 80 distinct words of a hundred; C: over 10 characters of A-Z in a hundred; D: one of # $ % & * |; E: the text
    is that of a smaller doc_id too. good and toxic are labels of 1 for the doc_id, by any of its rows in labels (doc_id, quality, toxic).
    A null or empty text has no words and equals other such ones; of rows of one doc_id none is smaller, and a null id is above all others. Long
    texts are read whole; repeated rows give repeated rows; a null lang is the empty part; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split("_text", WORDS), "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text")).withColumn("_words", words)
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    upper = F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))
    flags = own.select(
        "doc_id", "part", (n < 100).alias("A"), (100 * distinct < 80 * n).alias("B"), (100 * upper.cast("long") > 10 * F.length("_text").cast("long")).alias("C"), F.col("_text").rlike(SIGNS).alias("D"), F.unhex(F.sha2("_text", 256)).alias("digest")
    )
    flags = materialise(flags, "measures")
    copies = flags.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    copies = materialise(copies, "digests")  # or the join below would stand in one stage with this sum, which cannot be split
    flags = materialise(flags.join(copies, F.col("digest") == F.col("_digest"), "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.coalesce("doc_id", F.lit((1 << 63) - 1)) > F.col("_least"), F.lit(False)).alias("E")), "copies")
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return flags.join(known, F.col("doc_id") == F.col("_id"), "left").select("part", *LETTERS, "good", "toxic")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, LETTERS, ("good", "toxic")).drop("filter")


ORACLE = """
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents
), words AS (
    SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w FROM texts
), flags AS (
    SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
           100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
           doc_id > min(doc_id) OVER (PARTITION BY x) AS e
    FROM words
), known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), groups AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
    FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), orders AS (
    SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
), edges AS (
    SELECT part, bit, before,
           coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(n) FILTER (good AND fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
           coalesce(sum(n) FILTER (toxic AND fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
    FROM groups, (SELECT DISTINCT bit, before FROM steps) GROUP BY part, bit, before
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM steps JOIN edges USING (bit, before)
"""

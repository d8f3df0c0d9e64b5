"""The corpus pipeline: documents through quality rules, near-dedup, repeat removal, sanitising and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import fertility, packing, pii, simhash, suffix_repeats
from ravelin.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: repeats, and measures by two vocabularies outside their language's bands.

    Short documents stay if their measures are like prose. Null, empty and blank texts go. Long texts are measured whole. Rows that
    repeat both id and text stay or go together; null ids are ids like any other; columns may have any other names. An empty table stays empty.
    """
    path, second = public_tokenizers.path(fertility.VOCABULARY), public_tokenizers.path(fertility.SECOND_VOCABULARY)
    return fertility.keep_good(docs, path, second, least_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) one document stays: that of the least id, nulls last.

    Of rows that repeat both id and text one stays. Texts without words (null, empty, blank) are one group. Long texts are read whole.
    Rows of one id and several texts are documents of their own, by a hash of the text. Columns may have any other names. An empty table stays empty.
    """
    inner = docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)))
    own, key = suffix_repeats.numbered(inner)
    groups = simhash.near_texts(own.select(F.col("uid").cast("long").alias("uid"), "text"))
    gone = groups.filter("uid <> component_id").select(F.col("uid").alias("_gone")).distinct()
    kept = own.join(gone, F.col("uid") == F.col("_gone"), "left_anti")
    return (kept if key else kept.dropDuplicates(["uid"])).select(*inner.columns).toDF(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier in the corpus are taken out of the texts; all rows and columns stay.

    Earlier is by id, nulls last, then by a hash of the text. A null text becomes empty; texts of under 100 bytes stay as they are. Long texts
    are read whole. Rows that repeat both id and text are one document, each with its text. n_chars follows the text. An empty table stays empty.
    """
    return suffix_repeats.without_repeats(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it become placeholders; all rows and columns stay.

    Null and empty texts stay as they are; long texts are read whole. Of overlapping spans the first names the placeholder. Repeated rows are
    treated alike. n_chars follows the text. An empty table stays empty.
    """
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: a row for each piece of a document.

    A null or empty text is its end mark alone; long texts are cut. Of documents of equal cost the first goes first. Each repeated row is packed.
    Columns other than doc_id and text are left behind. An empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("sanitise", sanitise), ("pack", pack)]

#: Fingerprint components, suffix arrays and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

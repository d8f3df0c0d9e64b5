"""Quality rules with tokeniser fertility.

Two public vocabularies measure each text: a subword one with byte fallback gives characters per token (fertility turned
over), letters and digits per token, the share of tokens that are byte fallbacks, and the entropy of the tokens; a byte-level one for
many languages gives its own characters per token.
Prose of a language holds each of these within a narrow band, while mark-up debris, tables,
encoded data and the like cost tokens without letters. The bands of each language are fitted to the
whole corpus: the median of all distinct texts that pass the base rules, and multiples of the median
absolute deviation around it, both drawn towards those of all languages as far as a language has few texts. Words are encoded one by one, as neither vocabulary's pieces cross white space.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.byte_bpe import PUBLIC_PATTERN, ranks_of
from ravelin.llm.common import WordEncoder, materialise, table

VOCABULARY, SECOND_VOCABULARY = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Base rules: fewer words, or more percent of the words in repeated 3-word windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Measures with a band: so many robust standard deviations below and above its language's median, with such a deviation at
#: least, about what prose has, so that copies with small changes do not narrow the band to nothing.
BANDS = {"letters_per_token": (5.0, 8.0, 0.04), "chars_per_token": (8.0, 8.0, 0.05), "second_chars_per_token": (8.0, 8.0, 0.05)}
#: The band of a text of n tokens is sqrt(1 + SHORT / n) times as wide: short texts vary more.
SHORT = 60
#: And its share of byte fallbacks at most so many above, with such a deviation at least.
FALLBACK_ABOVE, FALLBACK_LEAST = 12.0, 0.01
#: Bits of token entropy at least; ordinary prose of LEAST_WORDS words has over 5.
LEAST_ENTROPY, SHORT_ENTROPY = 3.0, 0.75
#: A language's deviation is held as if so many more of its texts had the deviation that texts have within all languages.
PRIOR_TEXTS = 10
#: Its median is held as if medians of languages lay around that of all texts with the deviation that they have, this at least. Where
#: no text at all passes the base rules, UNKNOWN stands for the median of all texts.
SPREAD = {"letters_per_token": 0.5, "chars_per_token": 0.5, "second_chars_per_token": 0.5, "fallback_share": 0.04}
UNKNOWN = {"letters_per_token": 3.0, "chars_per_token": 3.2, "second_chars_per_token": 3.2, "fallback_share": 0.0}

#: Bands of at most so many languages are sent to all tasks, 80 bytes each; the bands of more are joined, by a join that stands alone and can be split.
MOST_LANGUAGES = 100_000
#: Words that a worker keeps encoded.
CACHE_WORDS = 300_000
#: Metrics are binned for the bands: their histograms have a bounded number of rows per language.
BINS_PER_UNIT = 1000
NOT_LETTERS = re.compile(r"[\W_]+")
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, letters_per_token double, chars_per_token double, fallback_share double, entropy double, second_chars_per_token double"


class Measured(NamedTuple):
    """A word's ids as bytes of little-endian uint32, and its number of tokens in the second vocabulary."""

    ids: bytes
    second: int


@functools.lru_cache(2)
def pieces_of(path: str, second_path: str) -> tuple[WordEncoder, np.ndarray]:
    """An encoder of words (UTF-8 bytes) to Measured, and which ids are byte fallbacks."""
    from sentencepiece import SentencePieceProcessor
    from tiktoken import Encoding

    own = SentencePieceProcessor(model_file=path)
    fallback = np.array([own.is_byte(i) for i in range(own.get_piece_size())])
    second = Encoding("second", pat_str=PUBLIC_PATTERN, mergeable_ranks=ranks_of(second_path), special_tokens={})

    def encode(words: list[bytes]) -> list[Measured]:
        texts = [w.decode() for w in words]
        return [Measured(np.array(x, "<u4").tobytes(), len(second.encode_ordinary(" " + t))) for x, t in zip(own.encode(texts, num_threads=1), texts, strict=True)]

    return WordEncoder(encode, CACHE_WORDS), fallback


def n_repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)[1]
    _, at, n = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    twice, hit = n[at] > 1, np.zeros(len(w), bool)
    for k in range(3):
        hit[k : len(w) - 2 + k] |= twice
    return int(hit.sum())


def n_repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def measure(text: str | None, words: list[bytes], known: dict[bytes, Measured], fallback: np.ndarray) -> tuple:
    """Values of MEASURES; without words zeros, and null for the means."""
    text = text or ""
    n = len(words)
    repeated = n_repeated(words)
    got = [known[w] for w in words]
    ids = np.frombuffer(b"".join([x[0] for x in got]), "<u4")
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    out = (n, chars, sum(map(text.count, SYMBOLS)), n_repeated_lines(text), repeated, n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n)
    if not len(ids):
        return *out, 0, None, None, None, None, None
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = float(-(share * np.log2(share)).sum())
    return *out, len(ids), len(NOT_LETTERS.sub("", text)) / len(ids), chars / len(ids), float(fallback[ids].mean()), entropy, chars / sum([x[1] for x in got])


def measured(docs: DataFrame, path: str, second_path: str) -> DataFrame:
    """(doc_id, lang, text_hash, *MEASURES) per row of docs (doc_id, text, lang)."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, fallback = pieces_of(path, second_path)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                words = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
                known = coder.learn(set().union(*words))
                rows = [measure(t, w, known, fallback) for t, w in zip(texts, words, strict=True)]
                cols = {c: part.column(c) for c in ("doc_id", "lang", "text_hash")}
                yield pa.RecordBatch.from_pydict(cols | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, f"doc_id long, lang string, text_hash long, {MEASURES}")


def bands(rows: DataFrame) -> DataFrame:
    """(lang, most_fallback, and per measure of BANDS its middle, low and high) of each language, fitted to all measured texts that pass the base rules, copies counted once.

    A language of n texts with median m and deviation d within it: its deviation s is that of d and PRIOR_TEXTS of all languages' d0; its
    middle is the mean of m, weighed by n / s^2, and of all texts' median, weighed by 1 / spread^2; the band counts deviations of
    sqrt(s^2 + 1 / (sum of weights)). So bands narrow steadily from those of an unknown language (n = 0) to the language's own.
    """
    least = {c: b[2] for c, b in BANDS.items()} | {"fallback_share": FALLBACK_LEAST}
    own = rows.filter("not base_failed").groupBy("lang", "text_hash").agg(*[F.max(c).alias(c) for c in least])
    binned = own.select("lang", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(c) * BINS_PER_UNIT).cast("long").alias("bin")) for c in least])).alias("x"))
    bins = materialise(binned.groupBy("lang", "x.measure", "x.bin").agg(F.count("*").alias("n")), "bins")
    half = lambda value: F.percentile(value, F.lit(0.5), F.col("n"))
    middle = bins.groupBy("lang", "measure").agg(half(F.col("bin")).alias("middle"), F.sum("n").alias("n_texts"))
    away = bins.join(middle, ["lang", "measure"]).select("lang", "measure", "n", F.abs(F.col("bin") - F.col("middle")).alias("away"))
    unit = 1.4826 / BINS_PER_UNIT
    # a row for each measure
    of_all = {r.measure: r.middle / BINS_PER_UNIT for r in bins.groupBy("measure").agg(half(F.col("bin")).alias("middle")).collect()}
    within = {r.measure: r.away * unit for r in away.groupBy("measure").agg(half(F.col("away")).alias("away")).collect()}
    apart = F.abs(F.col("middle") - F.element_at(F.create_map(*[x for c in least for x in (F.lit(c), F.lit(of_all.get(c, UNKNOWN[c]) * BINS_PER_UNIT))]), F.col("measure")))
    between = {r.measure: r.apart * unit for r in middle.groupBy("measure").agg(F.percentile(apart, F.lit(0.5)).alias("apart")).collect()}

    both = middle.join(away.groupBy("lang", "measure").agg(half(F.col("away")).alias("away")), ["lang", "measure"])
    of = lambda c, name: F.max(F.when(F.col("measure") == c, F.col(name))).alias(f"{c}_{name}")
    wide = both.groupBy("lang").agg(*[of(c, name) for c in least for name in ("n_texts", "middle", "away")])
    out = rows.select("lang").distinct().join(wide, "lang", "left")
    for c in least:
        n, m, d = F.coalesce(f"{c}_n_texts", F.lit(0)), F.coalesce(f"{c}_middle", F.lit(0.0)) / BINS_PER_UNIT, F.coalesce(f"{c}_away", F.lit(0.0)) * unit
        spread = max(between.get(c, 0.0), SPREAD[c])
        s = F.greatest(F.sqrt((n * d * d + PRIOR_TEXTS * within.get(c, 0.0) ** 2) / (n + PRIOR_TEXTS)), F.lit(least[c]))
        out = out.withColumns({f"{c}_s": s}).withColumns({f"{c}_weight": n / F.col(f"{c}_s") ** 2})
        precision = F.col(f"{c}_weight") + 1 / spread**2
        out = out.withColumns({f"{c}_middle": (F.col(f"{c}_weight") * m + of_all.get(c, UNKNOWN[c]) / spread**2) / precision, f"{c}_deviation": F.sqrt(F.col(f"{c}_s") ** 2 + 1 / precision)})
    limits = [F.col(f"{c}_middle") + k * F.col(f"{c}_deviation") for c, (below, above, _) in BANDS.items() for k in (-below, above)]
    names = [f"{c}_{side}" for c in BANDS for side in ("low", "high")]
    most = F.col("fallback_share_middle") + FALLBACK_ABOVE * F.col("fallback_share_deviation")
    return out.select("lang", *[f"{c}_middle" for c in BANDS], *[x.alias(name) for x, name in zip(limits, names, strict=True)], most.alias("most_fallback"))


def judge(docs: DataFrame, path: str, second_path: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """Verdict per row of docs (doc_id, text, lang), with all measures.

    kept is false if a text has fewer than least_words or fails the base rule of repeats; else it tells whether each measure of
    BANDS lies in its language's band, fallback_share is not above the language's most and entropy is at least LEAST_ENTROPY
    (or SHORT_ENTROPY of what so few tokens can have). base_failed is always by LEAST_WORDS. Null, empty
    and blank texts have no words and are never kept. A null language is a language of its own. Long texts are measured whole.
    Repeated rows each get their row; an empty table gives none; other columns are ignored.
    """
    rows = materialise(measured(docs, path, second_path), "measures")
    wide = F.sqrt(1 + F.lit(SHORT) / F.greatest("n_tokens", F.lit(1)))
    of_lang = materialise(bands(rows), "bands")
    if of_lang.count() <= MOST_LANGUAGES:
        of_lang = F.broadcast(of_lang)  # else every document of a language would meet in one task
    fitted = rows.join(of_lang, "lang", "left")
    for c in BANDS:
        fitted = fitted.withColumns({f"{c}_{side}": F.col(f"{c}_middle") + (F.col(f"{c}_{side}") - F.col(f"{c}_middle")) * wide for side in ("low", "high")})
    inside = (F.col("fallback_share") <= F.col("most_fallback")) & (F.col("entropy") >= F.least(F.lit(LEAST_ENTROPY), SHORT_ENTROPY * F.log2("n_tokens")))
    for c in BANDS:
        inside = inside & F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    return fitted.drop(*[f"{c}_middle" for c in BANDS]).withColumn("kept", (F.col("n_words") >= least_words) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")) & F.coalesce(inside, F.lit(False)))


def keep_good(docs: DataFrame, path: str, second_path: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever those are called.

    Null, empty and blank texts go, as they have no words. Long texts are measured whole. Rows that repeat both id and
    text are kept or dropped together, each as often as it is there; null ids are ids like any other. An empty table stays empty.
    """
    own = docs.toDF(*(c if c in ("doc_id", "text", "lang") else f"c{k}" for k, c in enumerate(docs.columns)))
    good = judge(own, path, second_path, least_words).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang")).distinct()
    good = materialise(good, "good")  # alone in the join below, so that rows repeated very often can be split
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")) & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("_lang"))
    return own.join(good, same, "left_semi").toDF(*docs.columns)


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return judge(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(SECOND_VOCABULARY)).drop("text_hash", "lang")

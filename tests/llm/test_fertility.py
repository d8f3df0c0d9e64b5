import math
import re
import statistics
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ravelin.llm import byte_bpe, fertility

PATH = public_tokenizers.path(fertility.VOCABULARY), public_tokenizers.path(fertility.SECOND_VOCABULARY)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 400 else None
    n = len(words)
    repeat = len(hit) if hit is not None else None
    return n, sum(map(len, words)), sum(w.count(c) for w in words for c in "#*$%&|<>"), dup, repeat, None if repeat is None else n < 50 or 100 * repeat > 50 * n


TEXTS = [None, "", " \n\t\x0b", "one", "a b c a b c a", "x # y | <z>\nx # y | <z>\n\n \n", "w " * 60, " ".join(f"w{i}" for i in range(60)), "a\u00a0b c\x1cd \x85", "日本語 " * 5, "z" * 50000]


def test_base_measures(spark):
    df = spark.createDataFrame([(k, t, "en", 7) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in fertility.judge(df, *PATH).collect()}
    for k, t in enumerate(TEXTS):
        assert tuple(got[k][c] for c in BASE) == brute(t), t
        assert got[k].kept <= (not got[k].base_failed)
    assert fertility.judge(df.limit(0), *PATH).count() == 0
    assert fertility.judge(df.union(df), *PATH).count() == 2 * len(TEXTS)


def test_junk_goes_and_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = fertility.op2_fertility(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
    kept = fertility.keep_good(docs, *PATH)
    assert kept.columns == docs.columns and kept.count() == fertility.op2_fertility(spark, "/root/testdata/sf0.01").filter("kept").count()


def test_words_one_by_one_are_the_text():
    own = SentencePieceProcessor(model_file=PATH[0])
    text = "Some ordinary prose, with Ünïcode and 123 numbers 日本."
    assert own.encode(text) == [i for w in text.split() for i in own.encode(w)]


def test_copies_do_not_narrow_the_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'es'").select("doc_id", "text", "lang").collect()
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = {r.doc_id: (r.kept, r.letters_per_token) for r in fertility.judge(df(docs), *PATH).collect()}
    good = sorted((v[1], k) for k, v in alone.items() if v[0])
    middle = good[len(good) // 2][1]
    text = next(r.text for r in docs if r.doc_id == middle)
    for copies in (lambda k: text, lambda k: f"{text} {text.split()[k % 9]}"):  # exact ones, and ones with a word more
        got = {r.doc_id: r.kept for r in fertility.judge(df([*docs, *((10_000_000 + k, copies(k), "es") for k in range(2 * len(docs)))]), *PATH).collect()}
        assert sum(got[k] for _, k in good) >= 0.95 * len(good)
        assert all(kept for k, kept in got.items() if k >= 10_000_000)


def whole(text, own, second):
    """letters_per_token, chars_per_token, fallback_share, entropy and second_chars_per_token of the text encoded as a whole."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = own.encode(" ".join(words))
    counts, chars = Counter(ids), sum(map(len, words))
    letters = sum(c.isalnum() for w in words for c in w)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    return letters / len(ids), chars / len(ids), sum(own.is_byte(i) for i in ids) / len(ids), entropy, chars / len(second.encode_ordinary(" " + " ".join(words)))


def test_measures_bands_and_verdicts_by_brute_force(spark):
    own = SentencePieceProcessor(model_file=PATH[0])
    second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH[1]), special_tokens={})
    rows = {r.doc_id: r for r in fertility.op2_fertility(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    names = ("letters_per_token", "chars_per_token", "fallback_share", "entropy", "second_chars_per_token")
    got = {k: dict(zip(names, whole(d.text, own, second), strict=True)) for k, d in docs.items() if d.text and d.text.split()}
    for k, m in got.items():
        assert all(abs(rows[k][c] - m[c]) < 1e-9 for c in names if docs[k].text.isprintable() or c != "letters_per_token")
    limits = limits_by_brute_force({k: (docs[k].lang, docs[k].text, m) for k, m in got.items() if not rows[k].base_failed})
    for k, m in got.items():
        kept = not rows[k].base_failed and m["entropy"] >= 3
        wide = math.sqrt(1 + fertility.SHORT / rows[k].n_tokens)
        for c, (below, above, _) in fertility.BANDS.items():
            middle, deviation = limits[docs[k].lang, c]
            kept = kept and middle - below * deviation * wide <= m[c] <= middle + above * deviation * wide
        middle, deviation = limits[docs[k].lang, "fallback_share"]
        assert rows[k].kept == (kept and m["fallback_share"] <= middle + fertility.FALLBACK_ABOVE * deviation), k


def limits_by_brute_force(texts):
    """(language, measure) -> middle and deviation, of {id: (language, text, measures)}."""
    limits = {}
    for c in (*fertility.BANDS, "fallback_share"):
        least = fertility.BANDS[c][2] if c in fertility.BANDS else fertility.FALLBACK_LEAST
        of = {}
        for lang, text, m in texts.values():
            of.setdefault(lang, {})[text] = math.floor(m[c] * 1000 + 0.5) / 1000
        values = {lang: list(v.values()) for lang, v in of.items()}
        middle = {lang: statistics.median(v) for lang, v in values.items()}
        of_all = statistics.median(x for v in values.values() for x in v)
        within = 1.4826 * statistics.median(abs(x - middle[lang]) for lang, v in values.items() for x in v)
        spread = max(1.4826 * statistics.median(abs(x - of_all) for x in middle.values()), fertility.SPREAD[c])
        for lang, v in values.items():
            own, n = 1.4826 * statistics.median(abs(x - middle[lang]) for x in v), len(v)
            s = max(math.sqrt((n * own**2 + fertility.PRIOR_TEXTS * within**2) / (n + fertility.PRIOR_TEXTS)), least)
            weights = n / s**2, 1 / spread**2
            limits[lang, c] = (weights[0] * middle[lang] + weights[1] * of_all) / sum(weights), math.sqrt(s**2 + 1 / sum(weights))
    return limits


def test_rare_languages_and_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    german = {r.doc_id: r.kept for r in fertility.judge(docs.filter("lang = 'de'"), *PATH).collect()}
    some = docs.filter("lang = 'de'").orderBy("doc_id").limit(12).withColumn("lang", F.lit("xx"))
    few = {r.doc_id: r.kept for r in fertility.judge(some.unionByName(docs.filter("lang <> 'de'")), *PATH).collect()}
    rare = [r.doc_id for r in some.collect()]
    assert {german[k] for k in rare} == {True, False} and all(few[k] == german[k] for k in rare)
    alone = {r.doc_id: r.kept for r in fertility.judge(some, *PATH).collect()}
    assert all(alone[k] for k in rare if labels.get(k) == 1)
    # a language without any text that passes the base rules, and a table of such ones alone
    prose = " ".join(some.filter(f"doc_id = {next(k for k in rare if german[k])}").first().text.split()[:30])
    short = spark.createDataFrame([(-1, prose, "yy")], docs.schema)
    for table in (short.unionByName(docs), short):
        assert fertility.judge(table, *PATH, least_words=1).filter("doc_id = -1").first().kept
        assert not fertility.judge(table, *PATH).filter("doc_id = -1").first().kept


def test_short_prose_stays_where_asked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in fertility.keep_good(docs, *PATH, least_words=1).select("doc_id").collect()}
    good, bad = [k in kept for k, q in labels.items() if q == 1], [k in kept for k, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)

"""Named queries over the driver tables, each with the SQL that must give the same rows.

Doubles that are sums or means are rounded to six places on both sides, as engines add in other orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import jsonrepair, numeric, phrases, text
from ravelin.functions.calc import calculate_steps
from ravelin.operators import aggregates, tables
from ravelin.operators.membership import KeyFilter
from ravelin.operators import relational as R
from ravelin.plans import ablation, gate, generation, live
from ravelin.sources import lines, providers
from ravelin.sources.jsonl import read_jsonl, replace_values, shared_folder, upsert, write_jsonl, write_swapped
from ravelin.sources.versioned import VersionedTable
from ravelin.streaming import progress as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEP = "chr(31)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# SQL of sentences: split at white space after . ! or ?, stripped, without blanks.
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(replace(replace(trim({{0}}, e' \\t\\n\\r'), e'\\r', ''), e'\\n', ' '), '([.!?])\\s+', '\\1' || {SEP}, 'g'), {SEP}), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '')"
# As text.question_last, over a list s: the last item that ends in ? goes to the end.
QUESTION_LAST = "CASE WHEN q = 0 OR q = len(s) THEN s ELSE s[:q - 1] || s[q + 1:] || [s[q]] END"
LAST_QUESTION = "coalesce(list_max(list_filter(range(1, len(s) + 1), lambda i: ends_with(s[i], '?'))), 0)"

# -- scans, joins, aggregates --


@query("""
WITH x AS (
  SELECT d.lang, d.source, d.n_chars, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 1 THEN 'keep' ELSE 'review' END AS label
  FROM documents d LEFT JOIN labels l USING (doc_id)
)
SELECT lang, coalesce(source, '_overall') AS source, count(*) AS n, sum(CASE WHEN label = 'keep' THEN 1 ELSE 0 END)::BIGINT AS n_keep,
       sum(CASE WHEN label = 'drop' THEN 1 ELSE 0 END)::BIGINT AS n_drop, round(avg(n_chars), 6) AS avg_chars
FROM x GROUP BY GROUPING SETS ((lang, source), (lang))""")
def label_summary_grouping_sets(spark, sf):
    d, labels = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), t(spark, sf, "labels")
    label = F.when(F.col("quality").isNull(), "unknown").when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "keep").otherwise("review")
    x = d.join(labels, "doc_id", "left").withColumn("label", label)
    return x.groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "keep").alias("n_keep"), F.count_if(F.col("label") == "drop").alias("n_drop"), r6(F.avg("n_chars")).alias("avg_chars")).select("lang", F.coalesce("source", F.lit("_overall")).alias("source"), "n", "n_keep", "n_drop", "avg_chars")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, min(source) AS first_source FROM documents GROUP BY lang")
def count_by_key(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.min("source").alias("first_source"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_types, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def distinct_sets(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_types"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("SELECT user_id, count(*) AS n_types, sum(n)::BIGINT AS n_events FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def group_to_maps(spark, sf):
    e = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = R.map_of_groups(e, "user_id", "event_type")
    total = F.aggregate(F.map_values("rows"), F.lit(0).cast("long"), lambda s, v: s + v.n)
    return m.select("user_id", F.size("rows").cast("long").alias("n_types"), total.alias("n_events"))


@query("SELECT quality, toxic, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS exact_match_acc, count(*) AS n FROM labels GROUP BY ALL")
def exact_match(spark, sf):
    return t(spark, sf, "labels").groupBy("quality", "toxic").agg(r6(R.exact_match_accuracy(F.col("quality"), 1 - F.col("toxic"))).alias("exact_match_acc"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS fp,
                  sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS fn, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS tn FROM labels),
     m AS (SELECT *, (tp + tn) / greatest(1, tp + fp + fn + tn) AS accuracy, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall FROM c)
SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM m""")
def binary_metrics(spark, sf):
    m = R.binary_metrics(t(spark, sf, "labels").withColumn("p", 1 - F.col("toxic")), "quality", "p")
    return m.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("""
WITH f AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) AS rank FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o_custkey FROM orders JOIN f USING (o_custkey) WHERE rank > 10 AND rank <= 110""")
def first_seen_limit_offset(spark, sf):
    return R.first_seen(t(spark, sf, "orders"), "o_custkey", "o_orderkey", limit=100, offset=10).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins_per_key(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), "event_id", "value")
    return R.last_per_key(e, ["user_id", "event_type"], "seq").select("user_id", "event_type", "event_id", "value")


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'
UNION ALL SELECT o_orderkey, 'U', o_totalprice + 1 FROM orders WHERE o_orderstatus = 'F'""")
def upsert_by_key(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return upsert(o, new, ["o_orderkey"])


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'P')
UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus FROM orders WHERE o_orderstatus = 'O'""")
def replace_by_mode(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return replace_values(o, o.filter("o_orderstatus = 'O'").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000), "o_orderstatus", ["O", "P"])


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def must_match_join(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    r = t(spark, sf, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    c = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return R.must_match(R.must_match(c, n, ["nation"]), r, ["region"]).select("c_custkey", "n_name", "r_name")


@query(f"""
WITH m(mode, calls) AS (VALUES {", ".join(f"('{c[0]}', {c[2]})" for c in ablation.CONDITIONS)})
SELECT mode, c_mktsegment, count(*) AS n, sum(calls)::BIGINT AS call_budget FROM customer, m GROUP BY ALL""")
def condition_cross(spark, sf):
    x = ablation.crossed(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ablation.conditions(spark))
    return x.groupBy("mode", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("max_tool_calls").alias("call_budget"))


@query("""
SELECT doc_id, unnest(range(1, 1 + CASE quality + toxic WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END + CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END))::INT AS copy FROM labels""")
def oversample(spark, sf):
    confidence = F.when(F.col("quality") + F.col("toxic") == 2, "strong").when(F.col("quality") + F.col("toxic") == 1, "medium").otherwise("weak")
    source = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "cot_fixable").otherwise("")
    return R.oversample(t(spark, sf, "labels"), R.repeats_of(confidence, source)).select("doc_id", "copy")


ORDER_RESULTS = "SELECT o_orderpriority AS mode, o_orderstatus AS variant, o_totalprice > 200000 AS answer_correct FROM orders"


def order_results(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("variant"), (F.col("o_totalprice") > 200000).alias("answer_correct"))


@query(f"""
WITH x AS ({ORDER_RESULTS})
SELECT mode, round(avg(CASE WHEN variant = 'F' THEN answer_correct::INT * 100.0 END), 6) AS acc_f, round(avg(CASE WHEN variant = 'O' THEN answer_correct::INT * 100.0 END), 6) AS acc_o,
       round(avg(CASE WHEN variant = 'P' THEN answer_correct::INT * 100.0 END), 6) AS acc_p, round(avg(answer_correct::INT * 100.0), 6) AS overall FROM x GROUP BY mode""")
def accuracy_pivot(spark, sf):
    p = ablation.accuracy_table(order_results(spark, sf), ["F", "O", "P"])
    return p.select("mode", *[r6(F.col(c)).alias(f"acc_{c.lower()}") for c in "FOP"], r6(F.col("overall")).alias("overall"))


@query(f"""
WITH a AS (SELECT mode, variant, avg(answer_correct::INT) AS acc FROM ({ORDER_RESULTS}) GROUP BY ALL),
     b AS (SELECT *, CASE WHEN mode = '5-LOW' THEN '2-HIGH' ELSE '1-URGENT' END AS base_mode FROM a)
SELECT b.mode, b.variant, b.base_mode, round((b.acc - a.acc) * 100, 6) AS delta FROM b JOIN a ON a.mode = b.base_mode AND a.variant = b.variant WHERE b.mode <> b.base_mode""")
def accuracy_delta(spark, sf):
    s = order_results(spark, sf).groupBy("mode", "variant").agg(F.avg(F.col("answer_correct").cast("double")).alias("acc"))
    return R.accuracy_delta(s, {"5-LOW": "2-HIGH"}, "1-URGENT").withColumn("delta", r6(F.col("delta")))


ALIASES = "CASE event_type WHEN 'view' THEN 'LX' WHEN 'click' THEN 'HN1' WHEN 'purchase' THEN 'LEX' WHEN 'signup' THEN '' ELSE event_type END"


@query(f"""
WITH x AS (SELECT {ALIASES} AS alias FROM events)
SELECT CASE alias WHEN 'LX' THEN 'TB' WHEN 'HN1' THEN 'PED' WHEN 'HN2' THEN 'HU' WHEN 'LEX' THEN 'SP' WHEN '' THEN 'base' ELSE alias END AS variant, count(*) AS n FROM x GROUP BY 1""")
def alias_canonicalise(spark, sf):
    alias = F.expr(ALIASES)
    return t(spark, sf, "events").select(text.canonical_variant(alias).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT o_orderkey, list_transform([o_orderstatus, o_orderpriority, o_orderstatus, ''], lambda v: CASE v WHEN 'F' THEN 'LX' WHEN 'O' THEN 'TB' ELSE v END) AS v FROM orders),
     y AS (SELECT o_orderkey, list_transform(v, lambda v: CASE v WHEN 'LX' THEN 'TB' WHEN '' THEN 'base' ELSE v END) AS v FROM x)
SELECT o_orderkey, array_to_string(CASE WHEN v[1] = v[2] THEN [v[1], v[4]] ELSE [v[1], v[2], v[4]] END, ',') AS variants FROM y""")
def alias_lists(spark, sf):
    v = F.transform(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus", F.lit("")), lambda v: F.when(v == "F", "LX").when(v == "O", "TB").otherwise(v))
    return t(spark, sf, "orders").select("o_orderkey", F.array_join(text.canonical_variants(v), ",").alias("variants"))


# -- sentences and phrases --


@query(f"SELECT doc_id, len({SENTENCES.format('text')}) AS n_sentences, coalesce({SENTENCES.format('text')}[-1], '') AS last_sentence FROM documents")
def sentence_split_counts(spark, sf):
    s = t(spark, sf, "documents").select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(text.last(F.col("s")), F.lit("")).alias("last_sentence"))


@query(f"""
WITH x AS (SELECT item_id, {SENTENCES.format('text')} AS s FROM benchmark)
SELECT item_id, (k - 1)::INT AS idx, s[k] AS sentence, k = len(s) AS is_question FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS k FROM x)""")
def sentence_explode(spark, sf):
    s = t(spark, sf, "benchmark").select("item_id", text.split_sentences(F.col("text")).alias("s"))
    return s.select("item_id", F.size("s").alias("n"), F.posexplode("s").alias("idx", "sentence")).select("item_id", "idx", "sentence", (F.col("idx") == F.col("n") - 1).alias("is_question"))


def asked(spark, sf):
    """Benchmark sentences, a question mark put to the one at item_id modulo their number."""
    s = t(spark, sf, "benchmark").select("item_id", text.split_sentences(F.col("text")).alias("s"))
    at = F.pmod(F.col("item_id"), F.greatest(F.size("s"), F.lit(1))).cast("int")
    return s.select("item_id", F.transform("s", lambda x, i: F.when(i == at, F.concat(x, F.lit("?"))).otherwise(x)).alias("s"))


ASKED = f"SELECT item_id, list_transform(s, lambda x, i: CASE WHEN i - 1 = item_id % greatest(len(s), 1) THEN x || '?' ELSE x END) AS s FROM (SELECT item_id, {SENTENCES.format('text')} AS s FROM benchmark)"


@query(f"WITH x AS ({ASKED}), y AS (SELECT *, {LAST_QUESTION} AS q FROM x) SELECT item_id, array_to_string({QUESTION_LAST}, ' | ') AS sentences FROM y")
def question_last(spark, sf):
    return asked(spark, sf).select("item_id", F.array_join(text.question_last(F.col("s")), " | ").alias("sentences"))


@query(f"""
WITH x AS (SELECT item_id, {SENTENCES.format('text')} AS s FROM benchmark)
SELECT item_id, array_to_string(list_transform(s, lambda x, i: CASE WHEN i = len(s) THEN '[Q] ' WHEN (i - 1) % 2 = 0 THEN '[EVID] ' ELSE '[CTX] ' END || x), e'\\n') AS view,
       array_to_string(list_transform(s, lambda x, i: '[' || (i - 1) || '] ' || x), e'\\n') AS block FROM x""")
def core_view(spark, sf):
    s = t(spark, sf, "benchmark").select("item_id", text.split_sentences(F.col("text")).alias("s"))
    even = F.filter(text.indexes(F.size("s")), lambda i: i % 2 == 0)
    return s.select("item_id", text.core_view(F.col("s"), even).alias("view"), text.numbered_block(F.col("s")).alias("block"))


@query(f"""
WITH x AS (SELECT item_id, {SENTENCES.format('text')} AS s FROM benchmark), y AS (
  SELECT item_id, s, list_filter(range(0, len(s)), lambda i: regexp_matches(s[i + 1], '\\b\\d+\\b') OR len(list_filter([{", ".join(f"'{h}'" for h in text.RELATION_HINTS)}], lambda h: contains(lower(s[i + 1]), h))) > 0) AS e FROM x)
SELECT item_id, array_to_string(CASE WHEN len(e) = 0 THEN [0] ELSE e END, ',') AS heuristic, array_to_string(range(0, len(s)), ',') AS every FROM y""")
def pick_evidence(spark, sf):
    s = t(spark, sf, "benchmark").select("item_id", text.split_sentences(F.col("text")).alias("s"))
    j = lambda m: F.array_join(text.pick_evidence(F.col("s"), m).cast("array<string>"), ",")
    return s.select("item_id", j("heuristic").alias("heuristic"), j("all").alias("every"))


@query("""
WITH x AS (SELECT o_orderkey, list(l_linenumber - 2) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
     y AS (SELECT o_orderkey, list_sort(list_distinct(list_filter(ids, lambda i: i >= 0 AND i < 3))) AS e FROM x)
SELECT o_orderkey, array_to_string(CASE WHEN len(e) = 0 THEN [0] ELSE e END, ',') AS evidence FROM y""")
def evidence_sanitiser(spark, sf):
    o, li = t(spark, sf, "orders").select("o_orderkey"), t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    x = o.join(li, "o_orderkey").groupBy("o_orderkey").agg(F.collect_list(F.col("l_linenumber") - 2).alias("ids"))
    return x.select("o_orderkey", F.array_join(text.clean_evidence(F.col("ids"), F.lit(4)).cast("array<string>"), ",").alias("evidence"))


@query(r"""
SELECT doc_id, len(n)::BIGINT AS n_numbers, coalesce(n[1], '') AS first_number, coalesce(n[-1], '') AS last_number
FROM (SELECT doc_id, regexp_extract_all(text, '\b\d+(?:\.\d+)?\b') AS n FROM documents)""")
def numbers_in_text(spark, sf):
    n = t(spark, sf, "documents").select("doc_id", text.numbers_in(F.col("text")).alias("n"))
    return n.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.coalesce(F.get("n", F.lit(0)), F.lit("")).alias("first_number"), F.coalesce(text.last(F.col("n")), F.lit("")).alias("last_number"))


@query("""
SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, coalesce(w[-1], '') AS last_token
FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 3), lambda x: lower(x)) AS w FROM documents)""")
def content_tokens(spark, sf):
    w = t(spark, sf, "documents").select("doc_id", text.content_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.coalesce(text.last(F.col("w")), F.lit("")).alias("last_token"))


NOT_CORE = ", ".join(f"'{w}'" for w in text.NOT_CORE_WORDS)


@query(f"""
WITH x AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '\\b[A-Z][a-z]+\\b'), lambda x: x NOT IN ({NOT_CORE})))), ', ') AS core_words FROM x""")
def capitalised_words(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(text.core_words(F.col("text")), ", ").alias("core_words"))


PART_QUESTION = "'Each box has ' || p_size || ' ' || split_part(p_name, ' ', 2) || 's and ' || p_partkey || ' glasses per ' || split_part(p_name, ' ', 1) || '. Each ' || lower(p_type) || ' contains 7 boxes.'"


def part_questions(spark, sf):
    name = F.split("p_name", " ")
    q = F.concat(F.lit("Each box has "), F.col("p_size").cast("string"), F.lit(" "), F.get(name, F.lit(1)), F.lit("s and "), F.col("p_partkey").cast("string"), F.lit(" glasses per "), F.get(name, F.lit(0)), F.lit(". Each "), F.lower("p_type"), F.lit(" contains 7 boxes."))
    return t(spark, sf, "part").select("p_partkey", q.alias("question"))


def lemma_sql(w: str) -> str:
    return f"CASE WHEN ends_with({w}, 'ies') THEN {w}[:-4] || 'y' WHEN ends_with({w}, 'sses') OR ends_with({w}, 'xes') THEN {w}[:-3] WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN {w}[:-2] ELSE {w} END"


STOPPED = ", ".join(f"'{u}'" for u in text.STOP_UNITS)
HAS = "(?:has|having|contains)"


@query(f"""
WITH x AS (SELECT p_partkey, {PART_QUESTION} AS q FROM part), y AS (
  SELECT p_partkey, q, list_transform(regexp_extract_all(q, '\\b\\d+\\s+([A-Za-z]+s)\\b', 1) || regexp_extract_all(q, '\\beach\\s+([A-Za-z]+)\\s+{HAS}\\s+\\d+\\s+([A-Za-z]+)s\\b', 1)
    || regexp_extract_all(q, '\\beach\\s+([A-Za-z]+)\\s+{HAS}\\s+\\d+\\s+([A-Za-z]+)s\\b', 2) || regexp_extract_all(q, '\\bper\\s+([A-Za-z]+)\\b', 1), lambda w: lower(w)) AS w FROM x)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(w, lambda w: {lemma_sql('w')}), lambda u: u <> '' AND u NOT IN ({STOPPED})))), ',') AS units,
       array_to_string(list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(lower(q), 'each\\s+([a-z]+)\\s+{HAS}\\s+\\d+\\s+([a-z]+)s', 2), regexp_extract_all(lower(q), 'each\\s+([a-z]+)\\s+{HAS}\\s+\\d+\\s+([a-z]+)s', 1)), lambda z: z[1] || ' per ' || z[2]))), ',') AS pairs FROM y""")
def plural_units(spark, sf):
    q = part_questions(spark, sf)
    return q.select("p_partkey", F.array_join(text.units(F.col("question")), ",").alias("units"), F.array_join(F.array_sort(text.forbidden_pairs(F.col("question"))), ",").alias("pairs"))


@query(f"""
WITH x AS (SELECT p_partkey, {PART_QUESTION} AS q FROM part), y AS (
  SELECT p_partkey, list_filter(list_transform(regexp_extract_all(q, '[A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in text.HINT_STOP_WORDS)})) AS w FROM x),
  z AS (SELECT p_partkey, list_filter(w, lambda v, i: list_position(w, v) = i) AS w FROM y)
SELECT p_partkey, array_to_string((w || list_filter(['item', 'group', 'container', 'participant', 'object'], lambda f: NOT list_contains(w, f)))[:4], ',') AS hints FROM z""")
def topic_hints(spark, sf):
    return part_questions(spark, sf).select("p_partkey", F.array_join(text.topic_hints(F.col("question"), F.array().cast("array<string>")), ",").alias("hints"))


def any_sql(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + ")"


@query(f"""
SELECT doc_id, {any_sql('text', text.RELATION_HINTS)} AS relation, {any_sql('text', text.DIFFERENCE_MARKERS)} AS difference, {any_sql('text', text.HEDGING_MARKERS)} AS hedging,
       {any_sql('text', text.SOLVING_MARKERS)} AS solving, {any_sql('text', text.ASSERTION_MARKERS)} AS asserting, regexp_matches(text, '\\b\\d+\\b') AS has_number FROM documents""")
def phrase_flags(spark, sf):
    lists = {"relation": text.RELATION_HINTS, "difference": text.DIFFERENCE_MARKERS, "hedging": text.HEDGING_MARKERS, "solving": text.SOLVING_MARKERS, "asserting": text.ASSERTION_MARKERS}
    return t(spark, sf, "documents").select("doc_id", phrases.held(F.col("text"), lists).alias("h"), text.has_number(F.col("text")).alias("has_number")).select("doc_id", "h.*", "has_number")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(lower(d.text), lower(b.text))")
def passage_leakage(spark, sf):
    """Documents that hold a whole passage: what is inside a passage is looked up among what documents hold, and hits are compared.

    Passages of six words or more are found by four inner words, of three or more by one, and shorter ones by their first letters. Only
    kinds that occur are looked up, by a filter of all keys where the document stands: only what passes becomes rows that are joined,
    and a key that many documents hold can be split there.
    """
    words = lambda c: F.split(F.lower(c), r"[ \t\n\r\x0b\f]+")
    gram = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    letters = F.least(F.length("passage"), F.lit(4))
    kind = F.when(F.size("w") >= 6, "four").when(F.size("w") >= 3, "one").otherwise(F.concat(F.lit("letters"), letters.cast("string")))
    key = F.when(F.size("w") >= 6, gram(F.col("w"), F.lit(2), 4)).when(F.size("w") >= 3, gram(F.col("w"), F.lit(2), 1)).otherwise(F.xxhash64(F.substring("passage", F.lit(1), letters)))
    b = t(spark, sf, "benchmark").select("item_id", F.lower("text").alias("passage")).filter("passage <> ''").withColumn("w", words(F.col("passage")))
    b = b.select("item_id", "passage", kind.alias("kind"), key.alias("key"))
    kinds = sorted(r.kind for r in b.select("kind").distinct().collect())  # six at most
    d = t(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")).withColumn("w", words(F.col("text")))
    keys = {"four": F.transform(text.indexes(F.size("w") - 3), lambda i: gram(F.col("w"), i + 1, 4)), "one": F.transform("w", lambda x: F.xxhash64(x))}
    letter_keys = lambda n: F.transform(text.indexes(F.length("text") - n + 1), lambda i: F.xxhash64(F.substring(F.col("text"), i + 1, F.lit(n))))
    keys |= {f"letters{n}": letter_keys(n) for n in range(1, 5)}

    def hits(kind: str) -> DataFrame:
        own = b.filter(F.col("kind") == kind).select("item_id", "key")
        known = KeyFilter(own.select("key").distinct(), "key")
        # explode or a filter of arrays would have the optimiser copy the words into every step of the lambda
        return d.select("doc_id", F.explode_outer(F.array_distinct(F.filter(keys[kind], known.passes))).alias("key")).filter("key IS NOT NULL").join(own, "key")

    found = [hits(k) for k in kinds]
    pairs = reduce(DataFrame.union, [f.select("doc_id", "item_id") for f in found], d.select("doc_id", F.lit(0).cast("long").alias("item_id")).limit(0)).distinct()
    checked = pairs.join(b.select("item_id", "passage"), "item_id").join(d.select("doc_id", "text"), "doc_id")
    return checked.filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id")


@query("""
WITH w AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS w FROM benchmark)
SELECT a.item_id AS left_id, b.item_id AS right_id, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL HAVING count(*) >= 6""")
def token_overlap_pairs(spark, sf, least=6):
    """Pairs of items with so many words in common. Of two such sets, ordered by how rare their words are, the first ones, all but least - 1, share a word: only these are joined."""
    items = t(spark, sf, "benchmark").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_set(text.content_tokens(F.col("text"))))).alias("words")).filter(F.size("words") >= least)
    each = items.select("item_id", F.explode("words").alias("w"))
    ranked = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ranked"))
    rare = ranked.select("item_id", F.explode(F.slice("ranked", F.lit(1), F.size("ranked") - (least - 1))).alias("x")).select("item_id", "x.w")
    pairs = rare.withColumnRenamed("item_id", "left_id").join(rare.withColumnRenamed("item_id", "right_id"), "w").filter("left_id < right_id").select("left_id", "right_id").distinct()
    sides = [items.select(F.col("item_id").alias(f"{s}_id"), F.col("words").alias(s)) for s in ("left", "right")]
    shared = pairs.join(sides[0], "left_id").join(sides[1], "right_id").withColumn("shared", F.size(F.array_intersect("left", "right")).cast("long"))
    return shared.filter(F.col("shared") >= least).select("left_id", "right_id", "shared")


@query("""
SELECT p_partkey, NOT contains(lower(p_name || ' costs'), lower(p_brand)) AND NOT contains(lower(p_name || ' costs'), 'blue') AS no_leakage FROM part""")
def leakage_check(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", text.no_leakage(F.array(F.col("p_name"), F.lit("costs")), F.col("p_brand"), F.array(F.lit("Blue"))).alias("no_leakage"))


# -- numbers, answers, evidence --

SIGNED = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


@query(f"""
SELECT event_id, try_cast(nullif(regexp_extract(replace(props, ',', ''), '{SIGNED}'), '') AS DOUBLE) AS in_props,
       try_cast(regexp_extract_all(event_type || ' 1,234 ' || value::VARCHAR || ' end', '{SIGNED}')[-1] AS DOUBLE) AS last_number,
       len(regexp_extract_all(props, '[-+*/%^;|()]'))::INT AS complexity FROM events""")
def number_normalise(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", numeric.to_number(F.col("props")).alias("in_props"), numeric.last_number(F.concat(F.col("event_type"), F.lit(" 1,234 "), F.col("value").cast("string"), F.lit(" end"))).alias("last_number"), numeric.complexity(F.col("props")).alias("complexity"))


@query(f"""
WITH x AS (SELECT event_id, event_type, value, try_cast(regexp_extract(props, '{SIGNED}') AS DOUBLE) AS k FROM events)
SELECT event_id, abs(floor(value) - k) < 1e-9 AS numbers_equal, event_type = 'view' AS texts_equal FROM x""")
def answers_equal(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", numeric.answers_equal(F.floor("value").cast("string"), F.col("props")).alias("numbers_equal"), numeric.answers_equal(F.concat(F.lit(" "), F.upper("event_type")), F.lit("v ie w")).alias("texts_equal"))


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list_distinct(coalesce(list(l_linenumber) FILTER (l_returnflag = 'R'), []))) AS p, list_sort(list_distinct(coalesce(list(l_linenumber) FILTER (l_discount > 0.05), []))) AS g FROM lineitem GROUP BY l_orderkey),
     c AS (SELECT *, len(list_intersect(p, g)) AS tp FROM s),
     r AS (SELECT l_orderkey, p, g, CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT ELSE CASE WHEN len(p) = 0 THEN 0 ELSE tp / len(p) END END AS precision, CASE WHEN len(g) = 0 THEN 1 ELSE tp / len(g) END AS recall FROM c)
SELECT l_orderkey, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall,
       round(CASE WHEN len(g) = 0 THEN precision WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6)::DOUBLE AS f1, p = g AS exact FROM r""")
def evidence_prf(spark, sf):
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("p"), F.collect_set(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber"))).alias("g"))
    s = li.select("l_orderkey", numeric.evidence_scores(F.col("p"), F.col("g")).alias("s"))
    return s.select("l_orderkey", r6(F.col("s.precision")).alias("precision"), r6(F.col("s.recall")).alias("recall"), r6(F.col("s.f1")).alias("f1"), F.col("s.exact").alias("exact"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("""SELECT event_id, event_type AS topic, 1::BIGINT AS n_before, value::VARCHAR AS first_after FROM events""")
def noise_payload(spark, sf):
    e = t(spark, sf, "events")
    raw = F.to_json(F.struct(F.concat(F.lit(" "), F.col("event_type")).alias("topic"), F.array(F.lit(" "), F.col("event_type")).alias("before"), F.array(F.col("value").cast("string")).alias("after")))
    p = e.select("event_id", text.noise_payload(raw).alias("p"))
    return p.select("event_id", "p.topic", F.size("p.before").cast("long").alias("n_before"), F.get("p.after", F.lit(0)).alias("first_after"))


@query("SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1::BIGINT AS n_calls FROM events")
def tool_calls(spark, sf):
    e = t(spark, sf, "events")
    body = F.concat(F.lit('so <tool_call> {"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("} </tool_call> and <tool_call>broken</tool_call>"))
    c = e.select("event_id", text.xml_tool_calls(body).alias("c"))
    first = F.get("c", F.lit(0))
    return c.select("event_id", first["name"].alias("name"), F.get_json_object(first["arguments"], "$.k").cast("int").alias("k"), F.size("c").cast("long").alias("n_calls"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 1000)::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN (event_id % 7)::VARCHAR ELSE '' END AS answer FROM events""")
def candidate_answers(spark, sf):
    e, k = t(spark, sf, "events"), F.col("event_id") % 4
    s = lambda n: (F.col("event_id") % n).cast("string")
    said = F.when(k == 0, F.concat(F.lit('{"final_answer": "'), s(1000), F.lit('"}'))).when(k == 1, F.concat(F.lit("<answer> "), F.col("event_type"), F.lit(" </answer>"))).when(k == 2, F.concat(F.lit("3 and then "), s(7))).otherwise("none")
    return e.select("event_id", text.candidate_answer(said).alias("answer"))


@query("SELECT l_orderkey, l_linenumber, ((l_quantity::INT * (l_linenumber + 3) - 5)::BIGINT)::VARCHAR AS result, count(*) AS n FROM lineitem GROUP BY ALL")
def expression_eval(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    steps = F.array(F.concat(F.lit("x = "), F.col("l_quantity").cast("int").cast("string"), F.lit(" * ("), F.col("l_linenumber").cast("string"), F.lit(" + 3)")), F.lit("max(x - 5, x - 6.0)"))
    # equal steps are worked out once: their number is bounded by quantities and line numbers, not by rows
    known = li.select("l_quantity", "l_linenumber").distinct().withColumn("result", calculate_steps(steps))
    # dealt out before they are counted, or each task's table would hold whatever a file split holds
    dealt = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey", "l_linenumber")
    return dealt.join(F.broadcast(known), ["l_quantity", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber", "result").agg(F.count("*").alias("n"))


# -- traces, features, labels, model --


def traces(spark, sf):
    """A trace for each user: its events in order, errors as failed calls and views as calculator notices."""
    e = t(spark, sf, "events")
    output = F.when(F.col("event_type") == "error", "Error in step").when(F.col("event_type") == "view", "[CALCULATOR OFFLINE]").otherwise(F.floor("value").cast("string"))
    call = F.struct("ts", "event_id", F.struct(F.lit("calculator").alias("tool"), F.array(F.col("event_type")).alias("input"), output.alias("output"), F.col("event_id").cast("string").alias("tool_call_id")).alias("call"))
    by = e.groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("calls"), F.max_by("props", F.struct("ts", "event_id")).alias("last_props"))
    return by.select("user_id", F.transform("calls", lambda c: c.call).alias("tool_trace"), "last_props")


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN '[' ELSE floor(value)::BIGINT::VARCHAR END AS o FROM events),
     s AS (SELECT user_id, list(o ORDER BY ts, event_id) FILTER (o NOT IN ('Error', '[')) AS s, count(*) AS n, sum((o = 'Error')::INT)::BIGINT AS errors FROM o GROUP BY user_id)
SELECT user_id, n::DOUBLE AS turn_index, coalesce(len(s), 0)::DOUBLE AS successful_calls, errors::DOUBLE AS error_count, greatest(0, 5 - n)::DOUBLE AS budget_remaining,
       CASE WHEN len(s) >= 2 THEN abs(s[-1]::DOUBLE - s[-2]::DOUBLE) ELSE 0 END AS last_two_output_diff, coalesce(s[-1]::DOUBLE, 0) AS last_output_magnitude, len(list_distinct(coalesce(s, [])))::DOUBLE AS n_distinct_outputs FROM s""")
def trace_features(spark, sf):
    own = gate.prepared(traces(spark, sf).withColumn("reasoning", F.lit("")).withColumn("pred_answer", F.lit("")))
    f = gate.feature_columns(n_chunks=F.lit(0), n_evidence=F.lit(0), expression=F.lit(""), limit=F.lit(5))
    names = ["turn_index", "successful_calls", "error_count", "budget_remaining", "last_two_output_diff", "last_output_magnitude", "n_distinct_outputs"]
    return own.select("user_id", *[f[n].alias(n) for n in names])


@query("""
WITH o AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad, value > 20 AS ok FROM events)
SELECT user_id || '/' || event_type AS setting, count(*) AS n, round(avg(ok::INT), 6) AS answer_acc, round(avg(CASE WHEN NOT ok AND event_type <> 'click' THEN 1 ELSE 0 END), 6) AS planning_error_rate,
       round(avg(CASE WHEN NOT ok AND event_type = 'click' THEN 1 ELSE 0 END), 6) AS expression_error_rate, round(avg(bad), 6) AS calc_error_rate FROM o GROUP BY ALL""")
def error_taxonomy(spark, sf):
    e = t(spark, sf, "events")
    call = F.struct(F.lit("calculator").alias("tool"), F.array(F.col("event_type")).alias("input"), F.when(F.col("event_type") == "error", "Error").otherwise("1").alias("output"), F.lit("c").alias("tool_call_id"))
    rows = e.select(F.col("user_id").cast("string").alias("mode"), F.col("event_type").alias("variant"), (F.col("value") > 20).alias("answer_correct"), F.lit(1.0).alias("evidence_f1"), (F.col("event_type") == "click").alias("evidence_exact_match"), F.array(call).alias("tool_trace"))
    report = ablation.error_report(rows)
    calc = rows.groupBy(F.concat_ws("/", "mode", "variant").alias("setting")).agg(r6(F.avg(ablation.tool_stats(F.col("tool_trace")).n_calc_errors)).alias("calc_error_rate"))
    return report.select("setting", "n", r6(F.col("answer_acc")).alias("answer_acc"), r6(F.col("planning_error_rate")).alias("planning_error_rate"), r6(F.col("expression_error_rate")).alias("expression_error_rate")).join(calc, "setting")


LABEL_ROWS = """
b AS (SELECT o_orderkey AS id, o_orderstatus AS variant, o_totalprice > 300000 AS correct, (o_orderkey % 4)::INT AS calls FROM orders),
c AS (SELECT o_orderkey AS id, o_totalprice > 200000 AS cot FROM orders),
g AS (SELECT o_orderkey AS id, o_totalprice > 100000 AS fixed, o_orderpriority IN ('1-URGENT', '2-HIGH') AS fired FROM orders WHERE o_orderstatus <> 'P')"""


def label_rows(spark, sf):
    o = t(spark, sf, "orders")
    key = [F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("variant")]
    error = F.struct(F.lit("calculator").alias("tool"), F.array(F.lit("1")).alias("input"), F.lit("Error").alias("output"), F.lit("").alias("tool_call_id"))
    trace = F.when(F.col("o_orderpriority") == "5-LOW", F.array(error)).otherwise(F.slice(F.array(error), 1, 0))
    baseline = o.select(*key, (F.col("o_totalprice") > 300000).alias("answer_correct"), (F.col("o_orderkey") % 4).cast("int").alias("tool_calls"), trace.alias("tool_trace"))
    cot = o.select(*key, (F.col("o_totalprice") > 200000).alias("answer_correct"))
    fired = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    gated = o.filter("o_orderstatus <> 'P'").select(*key, (F.col("o_totalprice") > 100000).alias("answer_correct"), fired.alias("gate_step_continue_count"), F.lit(0).alias("gate_one_more_used"))
    return baseline, cot, gated


@query(f"""
WITH {LABEL_ROWS}, x AS (SELECT *, o_orderpriority = '5-LOW' AS errors FROM b JOIN c USING (id) LEFT JOIN g USING (id) JOIN orders ON o_orderkey = id)
SELECT id, CASE WHEN correct THEN 'commit' WHEN cot THEN 'continue' WHEN calls < 2 THEN 'continue' ELSE 'commit' END AS step_paper,
       CASE WHEN correct THEN 'commit' WHEN calls < 2 THEN 'continue' ELSE 'commit' END AS step_alone,
       CASE WHEN correct THEN 'commit' WHEN cot THEN 'continue' WHEN coalesce(fired, false) AND fixed THEN 'continue' WHEN coalesce(fired, false) THEN 'commit' WHEN calls < 2 THEN 'continue' ELSE 'commit' END AS step_mixed,
       CASE WHEN correct THEN 'submit' WHEN calls <= 1 OR errors THEN 'one_more_turn' ELSE 'fallback_cot' END AS commit_alone,
       CASE WHEN correct THEN 'submit' WHEN cot THEN 'one_more_turn' WHEN coalesce(fired, false) AND fixed THEN 'one_more_turn' WHEN coalesce(fired, false) THEN 'submit' WHEN calls <= 1 OR errors THEN 'one_more_turn' ELSE 'fallback_cot' END AS commit_mixed
FROM x""")
def weak_labels(spark, sf):
    b, c, g = label_rows(spark, sf)
    made = {"step_paper": gate.step_labels_paper(b, c), "step_alone": gate.step_labels(b), "step_mixed": gate.step_labels_mixed(b, c, g), "commit_alone": gate.commit_labels(b), "commit_mixed": gate.commit_labels_mixed(b, c, g)}
    out = None
    for name, df in made.items():
        df = df.select("id", F.col("label").alias(name))
        out = df if out is None else out.join(df, "id")
    return out


LOW = "('0x' || substr(md5({0}), 17, 16))::UBIGINT"
HIGH = "('0x' || substr(md5({0}), 1, 16))::UBIGINT"


@query(f"""
WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_./%-]+'))) AS w FROM documents),
     b AS (SELECT doc_id, ({LOW.format("w")} % 64)::INT AS bin, count(*) AS n FROM w GROUP BY ALL),
     s AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM b GROUP BY doc_id)
SELECT doc_id, bin, round(n / size, 6) AS weight FROM b JOIN s USING (doc_id)""")
def hash_bow(spark, sf):
    """Nonzero bins of every whole text, as the gates' features have them: a row's work alone."""
    bags = gate.with_bags(t(spark, sf, "documents").select("doc_id", "text"), {"bag": (F.col("text"), 64)})
    # explode alone would have the optimiser copy all of the above into a filter below it
    return bags.select("doc_id", F.posexplode_outer("bag").alias("bin", "weight")).filter("weight > 0").select("doc_id", "bin", r6(F.col("weight")).alias("weight"))


@query(f"""
SELECT doc_id, ((({HIGH.format("doc_id::VARCHAR")} % 5) * 1 + {LOW.format("doc_id::VARCHAR")} % 5) % 5)::INT AS fold FROM documents""")
def md5_folds(spark, sf):
    return t(spark, sf, "documents").select("doc_id", gate.fold(F.col("doc_id"), 5).alias("fold"))


@query("""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source),
f AS (SELECT 0::BIGINT AS r, list_transform(range(least(5, (SELECT count(*) FROM s))), lambda i: 0::BIGINT) AS load, NULL::VARCHAR AS source, 0::BIGINT AS place
  UNION ALL SELECT s.r, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + n ELSE x END), s.source, list_position(load, list_min(load)) FROM f JOIN s ON s.r = f.r + 1)
SELECT source, (place - 1)::INT AS fold FROM f WHERE r > 0""")
def balanced_folds(spark, sf):
    return gate.balanced_folds(t(spark, sf, "documents"), "source")


TEXT_BINS = gate.FEATURE_SPEC["text_bins"]


@query(f"""
WITH {LABEL_ROWS}, r AS (SELECT id, correct, cot, calls, (o_orderpriority = '5-LOW')::INT AS errors, o_orderpriority || ' then ' || o_orderstatus AS said FROM b JOIN c USING (id) JOIN orders ON o_orderkey = id),
l AS (SELECT *, (NOT correct AND (cot OR calls < 2))::INT AS y, CASE WHEN correct THEN 3 WHEN cot THEN 4 WHEN calls < 2 THEN 2 ELSE 1 END AS copies FROM r),
w AS (SELECT id, unnest(regexp_extract_all(lower(said), '[A-Za-z0-9_./%-]+')) AS w FROM l), n AS (SELECT id, 24 + ({LOW.format("w")} % {TEXT_BINS})::INT AS pos, count(*) AS n FROM w GROUP BY ALL),
z AS (SELECT id, sqrt(sum(n * n)) AS size FROM n GROUP BY id),
x AS (SELECT id, pos, n / size AS x FROM n JOIN z USING (id) UNION ALL SELECT id, unnest([0, 2, 3, 14, 15, 17]), unnest([errors, errors, 5 - errors, len(string_split(said, ' ')), 1, len(regexp_extract_all(said, '{SIGNED}'))])::DOUBLE FROM l),
m AS (SELECT pos, sum(x * copies) FILTER (y = 0) / (SELECT sum(copies) FROM l WHERE y = 0) AS a, sum(x * copies) FILTER (y = 1) / (SELECT sum(copies) FROM l WHERE y = 1) AS b FROM x JOIN l USING (id) GROUP BY pos),
v AS (SELECT pos, coalesce(b, 0) - coalesce(a, 0) AS weight, coalesce(a, 0) + coalesce(b, 0) AS total FROM m),
d AS (SELECT id, 1 / (1 + exp(-(sum(x * weight) - (SELECT sum(weight * total) / 2 FROM v)))) AS p FROM x JOIN v USING (pos) GROUP BY id)
SELECT id, y, round(p, 6) AS p, CASE WHEN calls < 5 AND p >= {gate.STEP_THRESHOLD} THEN 'continue' ELSE 'commit' END AS action FROM d JOIN l USING (id)""")
def trained_gate(spark, sf):
    """A step gate trained on runs that are right and wrong, with all sources of labels, and its decision for every run."""
    b, c, _ = label_rows(spark, sf)
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" then "), "o_orderstatus").alias("reasoning"))
    b = b.join(o, "id")
    samples = gate.step_samples(gate.step_labels_paper(b, c))
    own = gate.with_probability(samples, gate.train(samples, "continue", "paper")["model"])
    action = gate.step_decision(F.col("p"), F.col("tool_calls"), F.lit(5), F.lit(0)).action
    return own.select("id", (F.col("label") == "continue").cast("int").alias("y"), r6(F.col("p")).alias("p"), action.alias("action"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT + 42 AS seed FROM documents")
def stable_seed(spark, sf):
    return t(spark, sf, "documents").select("doc_id", numeric.problem_seed(F.col("doc_id").cast("string"), 42).alias("seed"))


@query("""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42/' || source || '/' || doc_id), doc_id) AS k FROM documents) WHERE k <= 3""")
def hash_topk_chunks(spark, sf):
    """Three documents of each source in a seeded order; each task keeps three of a source, so no source is gathered."""
    d = t(spark, sf, "documents").select("source", "doc_id", F.md5(F.concat_ws("/", F.lit("42"), "source", F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("h", "doc_id")
    return d.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("source", "doc_id")


@query(f"""
WITH x AS (SELECT item_id, {SENTENCES.format('text')} AS s FROM benchmark), c AS (SELECT item_id, s, unnest(range(0, len(s) - 1)) AS i FROM x),
     o AS (SELECT item_id, i, i % 2 = 0 AS ev, row_number() OVER (PARTITION BY item_id, i % 2 = 0 ORDER BY CASE WHEN i % 2 = 0 THEN lpad(i::VARCHAR, 9, '0') ELSE md5('42/' || item_id || '/' || i) END) AS k FROM c),
     r AS (SELECT item_id, i, row_number() OVER (PARTITION BY item_id ORDER BY ev DESC, k) AS k FROM o WHERE NOT ev OR k <= 1)
SELECT item_id, string_agg(i::VARCHAR, ',' ORDER BY k) AS chosen FROM r WHERE k <= 3 GROUP BY item_id""")
def guaranteed_retrieval(spark, sf):
    s = t(spark, sf, "benchmark").select("item_id", text.split_sentences(F.col("text")).alias("s")).filter(F.size("s") > 1)
    even = F.filter(text.indexes(F.size("s")), lambda i: i % 2 == 0)
    c = s.select("item_id", ablation.chunks(F.col("s"), even, F.array().cast("array<int>"), F.lit("base")).alias("c"))
    got = ablation.retrieve(F.col("c"), F.col("item_id").cast("string"), 3, 42, guarantee_evidence=True)
    return c.select("item_id", F.array_join(F.transform(got, lambda x: x["index"].cast("string")), ",").alias("chosen"))


MEANS = "SELECT (label % 2)::INT AS y, k - 1 AS pos, avg(embedding[k]::DOUBLE) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY ALL"


def vectors(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features"))


@query(f"SELECT y, pos::INT AS pos, round(mean, 6) AS mean FROM ({MEANS})")
def class_mean_linear(spark, sf):
    return gate.class_means(vectors(spark, sf)).select("y", "pos", r6(F.col("mean")).alias("mean"))


SCORE = f"""
m AS ({MEANS}), w AS (SELECT pos, max(mean) FILTER (y = 1) - max(mean) FILTER (y = 0) AS w, max(mean) FILTER (y = 1) + max(mean) FILTER (y = 0) AS s FROM m GROUP BY pos),
b AS (SELECT -sum(w * s) / 2 AS bias FROM w), e AS (SELECT vec_id, k - 1 AS pos, embedding[k]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)),
z AS (SELECT vec_id, sum(x * w) + any_value(bias) AS z FROM e JOIN w USING (pos), b GROUP BY vec_id)"""


@query(f"WITH {SCORE} SELECT vec_id, round(z, 5) AS decision, round(1 / (1 + exp(-z)), 5) AS p FROM z")
def linear_score(spark, sf):
    v = vectors(spark, sf)
    m, x = gate.fit_linear(v), F.col("features")
    return v.select("vec_id", F.round(m.decision(x), 5).alias("decision"), F.round(m.probability(x), 5).alias("p"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 >= 3 OR event_id % 7 >= 5 THEN 'commit' WHEN value / 100 >= 0.05 THEN 'continue' ELSE 'commit' END AS action,
       CASE WHEN event_id % 5 >= 3 OR event_id % 7 >= 5 THEN 0 ELSE value / 100 END AS p_continue FROM events""")
def gate_decision(spark, sf):
    d = gate.step_decision(F.col("value") / 100, F.col("event_id") % 7, F.lit(5), F.col("event_id") % 5)
    return t(spark, sf, "events").select("event_id", d.alias("d")).select("event_id", "d.action", "d.p_continue")


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN '[' ELSE floor(value)::BIGINT::VARCHAR END AS o FROM events),
     s AS (SELECT user_id, coalesce(list(o ORDER BY ts, event_id) FILTER (o NOT IN ('Error', '[')), []) AS s, count(*) AS n, max(o = 'Error') AS errors FROM o GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 3 = 0 OR user_id % 10 < 5 OR (n > 2 AND NOT errors) OR (n >= 2 AND len(s) >= 2 AND s[-1] = s[-2]) THEN 'submit' ELSE 'one_more_turn' END AS action FROM s""")
def commit_decision(spark, sf):
    x = traces(spark, sf).withColumn("last", F.coalesce(text.last(gate.successes(F.col("tool_trace"))), F.lit("")))
    d = gate.commit_decision((F.col("user_id") % 10) / 10, F.col("last"), F.col("tool_trace"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(0))
    return x.select("user_id", d.action.alias("action"))


# -- pipelines --


def problems(spark, sf):
    """Benchmark passages as problems: the first sentence asks, and the answer is the item's number."""
    b = asked(spark, sf)
    answer = F.concat(F.lit("So <<"), F.col("item_id").cast("string"), F.lit("+1="), (F.col("item_id") + 1).cast("string"), F.lit(">>.\n#### "), (F.col("item_id") + 1).cast("string"))
    return b.filter(F.size("s") > 0).select(F.col("item_id").cast("string").alias("id"), F.array_join("s", " ").alias("question"), answer.alias("answer"))


def list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VARIANT_ROWS = f"""
a AS ({ASKED}), p AS (SELECT item_id, {SENTENCES.format("array_to_string(s, ' ')")} AS s FROM a WHERE len(s) > 0), l AS (SELECT *, {LAST_QUESTION} AS q FROM p), c AS (SELECT item_id, {QUESTION_LAST} AS core FROM l),
f AS (SELECT item_id, core, list_transform(core[:-2], lambda s: replace(replace(s, 'Then ', 'After that, '), 'How many', 'Determine how many')) AS own, CASE WHEN contains(lower(array_to_string(core, ' ')), 'bookmark') THEN 'bookmark sales' ELSE 'school supplies' END AS topic FROM c),
n AS (SELECT item_id, core, 'base' AS variant, []::VARCHAR[] AS bank FROM f
  UNION ALL SELECT item_id, core, 'TB', list_transform({list_sql(generation.BACKGROUND)}, lambda s: replace(s, '{{topic}}', topic)) FROM f
  UNION ALL SELECT item_id, core, 'PED', {list_sql(generation.PARALLEL)} FROM f UNION ALL SELECT item_id, core, 'HU', {list_sql(generation.HEDGED)} FROM f
  UNION ALL SELECT item_id, core, 'SP', (own || own || own || own) FROM f WHERE len(own) > 0),
v AS (SELECT item_id, variant, core, bank[:2] AS before, bank[3:4] AS after FROM n)"""


@query(f"""
WITH {VARIANT_ROWS}
SELECT item_id::VARCHAR AS id, variant, array_to_string(before || core[:-2] || after || core[-1:], ' | ') AS sentences, array_to_string(range(len(before), len(before) + len(core) - 1), ',') AS evidence,
       array_to_string(range(0, len(before)) || range(len(before) + len(core) - 1, len(before) + len(core) - 1 + len(after)), ',') AS noise, len(before)::INT AS n_before, len(after)::INT AS n_after,
       CASE WHEN len(before) > 0 AND len(after) > 0 THEN 'both' WHEN len(before) > 0 THEN 'before' WHEN len(after) > 0 THEN 'after' END AS position FROM v""")
def variant_fanout(spark, sf):
    rows = generation.generate(problems(spark, sf))["benchmark"]
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("id", "variant", F.array_join("question_sentences", " | ").alias("sentences"), ids("evidence_sentence_ids").alias("evidence"), ids("noise_sentence_ids").alias("noise"), "n_before", "n_after", "position")


@query(f"""
WITH {VARIANT_ROWS}, m(mode, calls) AS (VALUES {", ".join(f"('{c[0]}', {int(c[1] in ('real', 'noop', 'perfect'))})" for c in ablation.CONDITIONS)})
SELECT mode, coalesce(variant, '_overall') AS variant, 1.0::DOUBLE AS acc, CASE WHEN variant IS NOT NULL THEN avg(calls) END AS avg_tool_calls, CASE WHEN variant IS NOT NULL THEN 1.0::DOUBLE END AS evidence_f1, count(*) AS n
FROM v, m GROUP BY GROUPING SETS ((mode, variant), (mode))""")
def mock_ablation(spark, sf):
    rows = generation.generate(problems(spark, sf))["benchmark"].withColumn("seq", F.col("id").cast("long"))
    return ablation.summary(ablation.run(rows))


def tokens_sql(s: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({s}, '[A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) >= 3))"


def whole_words_sql(s: str) -> str:
    return f"regexp_extract_all({s}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def marked(phrases: list[str], s: str = "s") -> str:
    return any_sql(s, phrases)


NUMBERS_SQL = r"regexp_extract_all({0}, '\b\d+(?:\.\d+)?\b')"
NO_NUMBER, NO_NAME = f"len({NUMBERS_SQL.format('s')}) = 0", f"len(list_intersect({whole_words_sql('lower(s)')}, names)) = 0"
PREFIXES = " OR ".join(f"starts_with(lower(core[i + 1]), '{p}')" for p in text.QUESTION_PREFIXES)


@query(f"""
WITH {VARIANT_ROWS}, z AS (SELECT item_id, array_to_string(s, ' ') AS q FROM a),
w AS (SELECT item_id, q, list_transform(list_filter(list_distinct({whole_words_sql('q')}), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND w NOT IN ({", ".join(f"'{x}'" for x in text.NOT_CORE_WORDS)})), lambda w: lower(w)) AS names,
  list_distinct({NUMBERS_SQL.format('q')}) AS numbers,
  list_transform(list_zip(regexp_extract_all(lower(q), 'each\\s+([a-z]+)\\s+{HAS}\\s+\\d+\\s+([a-z]+)s', 2), regexp_extract_all(lower(q), 'each\\s+([a-z]+)\\s+{HAS}\\s+\\d+\\s+([a-z]+)s', 1)), lambda z: z[1] || ' per ' || z[2]) AS pairs FROM z),
e AS (SELECT item_id, variant, core, before || after AS noise, list_filter(range(len(core)), lambda i: NOT (ends_with(core[i + 1], '?') OR {PREFIXES}) AND (regexp_matches(core[i + 1], '\\b\\d+\\b') OR {any_sql('core[i + 1]', text.RELATION_HINTS)})) AS ids FROM v WHERE variant <> 'base'),
t AS (SELECT e.*, names, numbers, pairs, list_transform(CASE WHEN len(ids) = 0 THEN [0] ELSE ids END, lambda i: {tokens_sql('core[i + 1]')}) AS evidence, lower(array_to_string(noise, ' ')) AS low FROM e JOIN w USING (item_id))
SELECT item_id::VARCHAR AS id, variant, len(list_filter(noise, lambda s: NOT CASE variant
    WHEN 'TB' THEN {NO_NUMBER} AND NOT {marked(text.DIFFERENCE_MARKERS)} AND NOT {marked(text.HEDGING_MARKERS)} AND NOT {marked(text.SOLVING_MARKERS)} AND {NO_NAME}
    WHEN 'PED' THEN {marked(text.DIFFERENCE_MARKERS)} AND {NO_NUMBER} AND NOT {marked(text.HEDGING_MARKERS)} AND {NO_NAME}
    WHEN 'HU' THEN {marked(text.HEDGING_MARKERS)} AND NOT {marked(text.DIFFERENCE_MARKERS)} AND {NO_NUMBER} AND NOT {marked(text.ASSERTION_MARKERS)}
    ELSE len(list_filter({NUMBERS_SQL.format('s')}, lambda n: NOT list_contains(numbers, n))) = 0 AND NOT {marked(text.DIFFERENCE_MARKERS)} AND NOT {marked(text.HEDGING_MARKERS)} AND NOT {marked(text.SOLVING_MARKERS)}
      AND len({tokens_sql('s')}) >= 2 AND len(list_filter(evidence, lambda g: len(list_intersect({tokens_sql('s')}, g)) >= 2)) > 0 END)) = 0 AS class_constraints,
  NOT contains(low, (item_id + 1)::VARCHAR) AND len(list_filter(pairs, lambda p: contains(low, p))) = 0 AS no_leakage, true AS truth_invariant FROM t""")
def validated_noise(spark, sf):
    v = generation.generate(problems(spark, sf))["validated"]
    return v.select("id", F.explode_outer("validated_noises").alias("variant", "checks"), F.col("meta_checks.truth_invariant").alias("truth_invariant")).select("id", "variant", "checks.*", "truth_invariant")


@query(f"""
WITH {VARIANT_ROWS}, m(mode) AS (VALUES ('gate_step'), ('gate_step_commit'))
SELECT mode, coalesce(variant, '_overall') AS variant, 1.0::DOUBLE AS acc, CASE WHEN variant IS NOT NULL THEN 1.0::DOUBLE END AS avg_tool_calls, CASE WHEN variant IS NOT NULL THEN 1.0::DOUBLE END AS evidence_f1, count(*) AS n
FROM v, m GROUP BY GROUPING SETS ((mode, variant), (mode))""")
def gated_ablation(spark, sf):
    """Step and commit gates trained on the mock run itself, and a run under them."""
    rows = generation.generate(problems(spark, sf))["benchmark"].withColumn("seq", F.col("id").cast("long"))
    base = ablation.run(rows, only=["fc_baseline"])
    step = gate.train(gate.step_samples(gate.step_labels(base)), "continue", "off-policy")
    commit = gate.train(gate.commit_samples(gate.commit_labels(base)), "one_more_turn", "off-policy")
    return ablation.summary(ablation.run(rows, only=["gate_step", "gate_step_commit"], step_model=step["model"], commit_model=commit["model"]))


@query("SELECT event_id, event_type AS kind, true AS ok, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_repair(spark, sf):
    e = t(spark, sf, "events")
    broken = F.concat(F.lit("<think>no</think>```json\n{'kind': '"), F.col("event_type"), F.lit("', 'ok': True, 'k': "), F.get_json_object("props", "$.k"), F.lit(",}\n```"))
    found = F.from_json(jsonrepair.object_text(broken), "kind string, ok boolean, k int")
    return e.select("event_id", found.alias("f")).select("event_id", "f.*")


def scripted(messages, choice):
    """A model that calculates 6*7 once where it has a tool, and answers what it got, or 42."""
    last = messages[-1]
    if choice == "required":
        return providers.Reply(None, [("call_0", "calculate", '{"calc_steps": ["x = 6*7", "x"]}')])
    if last["role"] == "tool" and not last["content"].startswith("[CALCULATOR"):
        return providers.Reply('<think>hm</think>{"reasoning": "calculated", "evidence_ids": [0], "final_answer": ""}')
    return providers.Reply("```json\n{'calc_chain': '6*7 = <42>', 'reasoning': 'it is 42', 'evidence_ids': [0], 'final_answer': '42',}\n```")


@query(f"""
WITH {VARIANT_ROWS}, m(mode, forced, tool, oracle) AS (VALUES {", ".join(f"('{c[0]}', {c[4] and c[1] in ('real', 'noop', 'perfect')}, '{c[1]}', {c[3]})" for c in ablation.CONDITIONS)}),
r AS (SELECT mode, variant, CASE WHEN tool = 'perfect' THEN 1.0 WHEN item_id + 1 = 42 THEN 1.0 ELSE 0.0 END AS ok, forced::INT AS calls,
             CASE WHEN oracle THEN 1.0 WHEN len(before) = 0 AND len(core) > 1 THEN 2.0 / len(core) ELSE 0.0 END AS f1 FROM v, m)
SELECT mode, coalesce(variant, '_overall') AS variant, round(avg(ok), 6)::DOUBLE AS acc, CASE WHEN variant IS NOT NULL THEN avg(calls)::DOUBLE END AS avg_tool_calls, CASE WHEN variant IS NOT NULL THEN round(avg(f1), 6)::DOUBLE END AS evidence_f1, count(*) AS n
FROM r GROUP BY GROUPING SETS ((mode, variant), (mode))""")
def live_ablation(spark, sf):
    """All conditions answered by a scripted model through the loop, the reply readers and the scores."""
    rows = generation.generate(problems(spark, sf))["benchmark"].withColumn("seq", F.col("id").cast("long"))
    found = ablation.summary(live.run(rows, lambda: providers.Answering(scripted), lambda df: df))
    return found.select("mode", "variant", r6(F.col("acc")).alias("acc"), "avg_tool_calls", r6(F.col("evidence_f1")).alias("evidence_f1"), "n")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS variant, o_orderpriority AS mode, round(o_totalprice, 2)::VARCHAR AS pred_answer, (o_totalprice > 100000) AS answer_correct, [o_custkey::INT, NULL] AS pred_evidence_ids FROM orders")
def jsonl_round_trip(spark, sf):
    """Rows written as JSON lines, nulls and arrays included, put in place of an older folder and read back by their declared schema."""
    o = t(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("mode"), F.round("o_totalprice", 2).cast("string").alias("pred_answer"), (F.col("o_totalprice") > 100000).alias("answer_correct"), F.array(F.col("o_custkey").cast("int"), F.lit(None)).alias("pred_evidence_ids"))
    path = f"{shared_folder(spark)}/round_trip-{uuid.uuid4().hex}"
    write_jsonl(rows.limit(1), path)
    write_swapped(rows, path)
    return read_jsonl(spark, path, rows.schema)


@query("SELECT o_orderkey AS id, o_orderstatus AS variant, o_totalprice AS price, 'é ' || o_orderpriority AS note, 0::BIGINT AS gap FROM orders")
def line_positions(spark, sf):
    """Rows written and read by the JSON-lines source: by a schema, and as lines, whose offsets must be where the lines before them end."""
    lines.register(spark)
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("variant"), F.col("o_totalprice").cast("double").alias("price"), F.concat(F.lit("é "), "o_orderpriority").alias("note"))
    path = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    o.repartition(4).write.format(lines.NAME).mode("append").save(path)
    rows = spark.read.format(lines.NAME).schema(f"id long, variant string, price double, note string, {lines.FILE} string, {lines.OFFSET} long").option("range_bytes", 100_000).load(path)
    from pyspark.sql import Window

    before = Window.partitionBy(lines.FILE).orderBy(lines.OFFSET).rowsBetween(Window.unboundedPreceding, -1)
    raw = spark.read.format(lines.NAME).load(path).select(lines.FILE, lines.OFFSET, (F.col(lines.OFFSET) - F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0))).alias("gap"))
    return rows.join(raw, [lines.FILE, lines.OFFSET]).drop(lines.FILE, lines.OFFSET)


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END::DOUBLE AS price FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderkey % 7 = 0
UNION ALL SELECT -o_orderkey, o_orderstatus, -1.0::DOUBLE FROM orders WHERE o_orderkey % 7 = 0""")
def versioned_upserts(spark, sf):
    """A versioned table: rows by key, a replacement by value, then an upsert of known and new keys."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"), "o_orderpriority")
    table = VersionedTable.create(o, f"{shared_folder(spark)}/versioned-{uuid.uuid4().hex}", ["o_orderkey", "o_orderstatus"], 16)
    table.replace(F.col("o_orderpriority") == "5-LOW", o.limit(0))
    some = o.filter("o_orderkey % 7 = 0").withColumn("price", F.lit(-1.0))
    table.upsert(some.union(some.withColumn("o_orderkey", -F.col("o_orderkey"))))
    return table.read().drop("o_orderpriority")


@query(f"""
WITH {VARIANT_ROWS}, i AS (SELECT item_id::VARCHAR AS id, variant, 'before' AS position, unnest(before) AS text, unnest(range(len(before))) AS k FROM v WHERE variant <> 'base'
  UNION ALL SELECT item_id::VARCHAR, variant, 'after', unnest(after), unnest(range(len(after))) FROM v WHERE variant <> 'base')
SELECT id, variant, position, k::INT AS k, text FROM i""")
def noise_by_table_function(spark, sf):
    """Noise of each problem by table functions, from SQL: three variants by a lateral join, one with the problems as a table argument."""
    tables.register(spark)
    core = generation.with_core(generation.with_schema(problems(spark, sf))).select("id", "core_sentences")
    lateral = "SELECT c.id, w.variant, n.* FROM {core} c, LATERAL explode(array('TB', 'PED', 'HU')) w(variant), LATERAL noise_of(c.core_sentences, w.variant, 2, 2) n"
    whole = "SELECT * FROM noise_rows(TABLE({core}), array('SP'), 2, 2)"
    made = spark.sql(lateral, core=core).union(spark.sql(whole, core=core).select("id", "variant", "position", "k", "text"))
    return made.select("id", "variant", "position", "k", "text")


@query("""
SELECT user_id, round(avg((floor(value)::BIGINT % 7 = event_id % 7)::INT), 6) AS exact_match_acc, round(sqrt(avg(power(floor(value) % 7 - event_id % 7, 2))), 6) AS root_mean_square,
       median(abs(floor(value) % 7 - event_id % 7))::DOUBLE AS median_error, 'bleu' AS unknown FROM events GROUP BY user_id""")
def metrics_by_name(spark, sf):
    """Metrics by name for each user: a built-in one, one of sums and one of whole groups; the last is called from SQL as well."""
    import numpy as np
    import pyarrow.compute as pc

    off = lambda p, g: pc.subtract(p, g)
    aggregates.register("root_mean_square", aggregates.Sums(2, lambda p, g: [pc.power(off(p, g), 2), pc.if_else(pc.is_valid(off(p, g)), 1, 0)], lambda s, n: F.sqrt(F.try_divide(s, n))))
    aggregates.register("median_error", aggregates.Whole(lambda p, g: float(np.median(np.abs(off(p, g).to_numpy(zero_copy_only=False))))), spark)
    e = t(spark, sf, "events").select("user_id", (F.floor("value") % 7).alias("pred"), (F.col("event_id") % 7).alias("gold"))
    found, unknown = aggregates.measured(e, ["exact_match_acc", "root_mean_square", "bleu"], "pred", "gold", ["user_id"])
    called = spark.sql("SELECT user_id AS _user, median_error(pred, gold) AS median_error FROM {e} GROUP BY user_id", e=e)
    both = found.join(called, F.col("user_id") == F.col("_user"))
    return both.select("user_id", r6(F.col("exact_match_acc")).alias("exact_match_acc"), r6(F.col("root_mean_square")).alias("root_mean_square"), "median_error", F.lit(",".join(unknown)).alias("unknown"))


# -- more scalar functions over tables --


@query("SELECT 'gsm8k/train/' || item_id AS id, trim(text, e' \\t\\n\\r') AS question, 'item ' || item_id AS answer FROM benchmark ORDER BY item_id LIMIT 25")
def export_ids(spark, sf):
    from ravelin.sources.jsonl import export_split

    b = t(spark, sf, "benchmark").select(F.col("item_id").alias("index"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("question"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("answer"))
    return export_split(b, "train", 25)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT || '*' || l_linenumber AS exprs, (l_quantity::INT * l_linenumber)::VARCHAR AS final, l_linenumber % 2 = 0 AS has_mark FROM lineitem""")
def calc_chains(spark, sf):
    li, q, n = t(spark, sf, "lineitem"), F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    product = (F.col("l_quantity").cast("int") * F.col("l_linenumber")).cast("string")
    even = F.col("l_linenumber") % 2 == 0
    answer = F.concat(F.lit("so <<"), q, F.lit("*"), n, F.lit("="), product, F.lit(">> and <<x=y>>"), F.when(even, F.concat(F.lit("\n####  "), product, F.lit(" "))).otherwise(F.concat(F.lit(" <<2+x="), product, F.lit(">>"))))
    c = li.select("l_orderkey", "l_linenumber", "l_partkey", even.alias("has_mark"), text.calc_chain(answer).alias("c"))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("c.exprs", ";").alias("exprs"), "c.final", "has_mark")


@query("""
SELECT o_orderkey, abs(o_totalprice - round(o_totalprice)) < 1e-9 AS holds FROM orders""")
def truth_invariant(spark, sf):
    o = t(spark, sf, "orders")
    whole = F.round("o_totalprice").cast("long").cast("string")
    return o.select("o_orderkey", numeric.truth_invariant(F.col("o_totalprice").cast("decimal(20,4)").cast("string"), F.concat(F.lit(" "), whole)).alias("holds"))


@query("""
SELECT event_id, event_type || ' end' AS spoken, event_type || '=1' AS expression, '1+1' AS first_step, 2::BIGINT AS n_steps FROM events""")
def cleaned_replies(spark, sf):
    e, kind = t(spark, sf, "events"), F.col("event_type")
    steps = text.chain_steps(F.concat(F.lit("1+1 ; "), kind, F.lit(" ;; final=2")))
    return e.select("event_id", text.without_think_tags(F.concat(F.lit(" <think>a\nb</think>"), kind, F.lit(" end\n"))).alias("spoken"), text.normal_expression(F.concat(F.lit(" "), F.upper(kind), F.lit(" =\t1 "))).alias("expression"), F.get(steps, F.lit(0)).alias("first_step"), F.size(steps).cast("long").alias("n_steps"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 50)::VARCHAR ELSE event_type END AS pred_answer, event_type AS reasoning, '1,' || event_id % 5 AS evidence FROM events""")
def recovered_fields(spark, sf):
    e, n = t(spark, sf, "events"), (F.col("event_id") % 50).cast("string")
    broken = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"pred_answer": "'), n, F.lit('", '))).otherwise(F.concat(F.lit("{<answer>"), F.col("event_type"), F.lit("</answer> ")))
    raw = F.concat(broken, F.lit('"reasoning": "'), F.col("event_type"), F.lit('", "evidence_ids": [1, '), (F.col("event_id") % 5).cast("string"))
    f = e.select("event_id", text.recovered_fields(raw).alias("f"))
    return f.select("event_id", "f.pred_answer", "f.reasoning", F.array_join(F.col("f.pred_evidence_ids").cast("array<string>"), ",").alias("evidence"))


@query("""
WITH o AS (SELECT user_id, event_id, ts, event_type, floor(value)::BIGINT::VARCHAR AS o, event_type NOT IN ('error', 'view') AS good FROM events),
     g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, o ORDER BY ts, event_id) > 1 AS duplicate,
                  last_value(CASE WHEN good THEN o END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_success,
                  count(*) FILTER (good) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_success FROM o)
SELECT event_id, duplicate, coalesce(last_success, '') AS last_success, n_success FROM g""")
def progress_markers(spark, sf):
    """Whether a call repeats an earlier one, and the progress so far: (number of successes, last success)."""
    from pyspark.sql import Window

    good = ~F.col("event_type").isin("error", "view")
    e = t(spark, sf, "events").withColumn("o", F.floor("value").cast("string"))
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("user_id", "event_type", "o").orderBy("ts", "event_id")
    return e.select("event_id", (F.row_number().over(same) > 1).alias("duplicate"), F.coalesce(F.last(F.when(good, F.col("o")), ignorenulls=True).over(so_far), F.lit("")).alias("last_success"), F.count(F.when(good, 1)).over(so_far).alias("n_success"))


@query("""
SELECT p_partkey, NOT regexp_matches(lower('The ' || p_name || ' costs 5 pages'), '\\b(' || split_part(p_name, ' ', 1) || ')\\b') AS neutral, true AS mentions FROM part""")
def unit_mentions(spark, sf):
    p = t(spark, sf, "part")
    s, first = F.concat(F.lit("The "), "p_name", F.lit(" costs 5 pages")), F.get(F.split("p_name", " "), F.lit(0))
    return p.select("p_partkey", text.neutral_units_only(s, F.array(F.lit("pages"), first)).alias("neutral"), text.mentions_any_word(F.upper(s), F.array(first, F.lit("none"))).alias("mentions"))


@query(f"""
WITH {LABEL_ROWS}, x AS (SELECT id, CASE WHEN correct THEN 'baseline_correct' WHEN cot THEN 'cot_fixable' WHEN calls < 2 THEN 'undercompute_heuristic' ELSE 'residual_commit' END AS s FROM b JOIN c USING (id))
SELECT s AS label_source, count(*) AS n, sum(CASE WHEN s IN ('cot_fixable', 'undercompute_heuristic') THEN 1 ELSE 0 END)::BIGINT AS n_positive FROM x GROUP BY s""")
def label_histogram(spark, sf):
    b, c, _ = label_rows(spark, sf)
    return gate.step_labels_paper(b, c).groupBy("label_source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "continue").alias("n_positive"))


@query("""
WITH x AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT a.user_id AS left_id, b.user_id AS right_id, count(*) AS shared FROM x a JOIN x b ON a.event_type = b.event_type AND a.user_id + 1 = b.user_id GROUP BY ALL""")
def set_intersection(spark, sf):
    """Event types that neighbouring users share, by array intersection."""
    e = t(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    b = e.select((F.col("user_id") - 1).alias("left_id"), F.col("user_id").alias("right_id"), F.col("s").alias("r"))
    return e.join(b, e.user_id == b.left_id).select("left_id", "right_id", F.size(F.array_intersect("s", "r")).cast("long").alias("shared")).filter("shared > 0")


@query("""
SELECT o_orderkey, o_orderpriority AS group_key, (('0x' || substr(md5(o_orderpriority), 1, 16))::UBIGINT % 5 + ('0x' || substr(md5(o_orderpriority), 17, 16))::UBIGINT % 5) % 5 <> 2 AS in_train FROM orders""")
def fold_membership(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("group_key"), (gate.fold(F.col("o_orderpriority"), 5) != 2).alias("in_train"))


@query(ORACLES["progress_markers"])
def progress_by_state(spark, sf):
    """The rows of progress_markers from a stream of the events, by keyed state."""
    streamed.configure(spark)
    path = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    events = t(spark, sf, "events")
    calls = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]").withColumn("output", F.floor("value").cast("string"))
    found = streamed.progress(calls.select("user_id", "ts", "event_id", "event_type", "output"))
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(streamed.OUT).parquet(f"{path}/rows")

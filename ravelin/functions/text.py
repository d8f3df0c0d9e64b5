"""Text columns: sentences, units, pairs, core views, markers, answers. Each takes and returns Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these words and patterns being just so.
VARIANTS = ["base", "TB", "PED", "HU", "SP"]
NOISY_VARIANTS = ["TB", "PED", "HU", "SP"]
VARIANT_ALIASES = {"LX": "TB", "HN1": "PED", "HN2": "HU", "LEX": "SP"}
VARIANT_NAMES = {"TB": "Thematic Background", "PED": "Parallel Entity Distractor", "HU": "Hedged Uncertainty", "SP": "Semantic Paraphrase"}
RELATION_HINTS = ["each", "per", "ratio", "rate", "every", "half", "double", "twice", "remaining", "leftover", "together", "altogether", "in total", "sum", "total"]
QUESTION_PREFIXES = ["how many", "how much", "what is", "what are", "find", "compute", "calculate", "determine"]
STOP_UNITS = ["time", "day", "week", "month", "number", "amount", "total", "sum", "value", "people"]
NEUTRAL_UNITS = ["books", "lights", "degrees", "kilometers", "tickets", "balloons", "pages", "bottles", "minutes", "kilograms", "meters"]
DIFFERENCE_MARKERS = ["another", "different", "elsewhere", "yesterday", "unrelated", "separate", "nearby", "in a different", "someone else", "not this case"]
HEDGING_MARKERS = ["claims", "claimed", "reported", "reportedly", "said", "unverified", "might", "possibly", "perhaps", "it is said", "it is possible", "some say", "around", "about", "likely", "not confirmed"]
SOLVING_MARKERS = ["multiply", "divide", "sum", "total", "fraction", "percent", "per", "each", "equation", "formula", "calculate", "compute", "add", "subtract"]
ASSERTION_MARKERS = ["the answer is", "correct answer", "choose option", "option x"]
NOT_CORE_WORDS = ["The", "A", "An", "If", "When", "Then", "It", "She", "He", "They", "How"]
HINT_STOP_WORDS = (
    "a an the of for to in on at by from with without within and or but if then else when"
    " while as into over under is are was were be been being this that these those each per"
    " has have having had do did does doing how what why many much all more left after before"
).split()
HINT_FALLBACK = ["item", "group", "container", "participant", "object"]
INTEGER = r"\b\d+\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
FINAL_ANSWER = r"####\s*([^\n\r]+)"
CALCULATION = r"<<([^<>]+?)>>"


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; \\b, \\d and \\s are Unicode-aware. Null for null."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def last(items: Column, back: int = 1) -> Column:
    return F.try_element_at(items, F.lit(-back))


def drop_last(items: Column) -> Column:
    return F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))


def indexes(n: Column) -> Column:
    """0 to n - 1; empty for n of 0, where sequence would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether lower-cased text holds any of the phrases, as substrings."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in phrases])


# -- variants --


def canonical_variant(variant: Column) -> Column:
    """Aliases resolved; null and empty are base."""
    known = F.create_map(*(F.lit(x) for pair in VARIANT_ALIASES.items() for x in pair))
    return F.when(variant.isNull() | (variant == ""), "base").otherwise(F.coalesce(F.try_element_at(known, variant), variant))


def canonical_variants(variants: Column) -> Column:
    """Distinct canonical names in first-seen order; null for null."""
    return F.array_distinct(F.transform(variants, canonical_variant))


# -- sentences --


def split_sentences(text: Column) -> Column:
    flat = F.replace(F.replace(strip(text), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.filter(F.transform(F.split(flat, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def question_last(sentences: Column) -> Column:
    """The last sentence that ends in ? moved to the end, unless the last one does; blanks go."""
    own = F.filter(F.transform(sentences, lambda s: strip(F.coalesce(s, F.lit("")))), lambda s: s != "")
    at = F.array_max(F.filter(indexes(F.size(own)), lambda i: F.endswith(F.get(own, i), F.lit("?"))))
    moved = F.concat(F.slice(own, 1, at), F.slice(own, at + 2, F.size(own)), F.array(F.get(own, at)))
    return F.when(at.isNull() | (at == F.size(own) - 1), own).otherwise(moved)


def is_question(sentence: Column) -> Column:
    low = F.lower(strip(sentence))
    return F.endswith(low, F.lit("?")) | reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in QUESTION_PREFIXES])


def has_number(sentence: Column) -> Column:
    return F.rlike(sentence, F.lit("(?U)" + INTEGER))


def has_relation_hint(sentence: Column) -> Column:
    return contains_any(sentence, RELATION_HINTS)


def core_view(sentences: Column, evidence: Column) -> Column:
    """A line for each sentence, marked [Q] for the last, [EVID] for evidence, [CTX] for others."""
    n = F.size(sentences)
    mark = lambda i: F.when(i == n - 1, "[Q] ").when(F.array_contains(evidence, i), "[EVID] ").otherwise("[CTX] ")
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(mark(i), strip(s))), "\n")


def numbered_block(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


# -- evidence --


def first_expression_numbers(expressions: Column) -> Column:
    return F.array_distinct(find_all(F.coalesce(F.get(expressions, F.lit(0)), F.lit("")), INTEGER))


def pick_evidence(sentences: Column, mode: str, expressions: Column | None = None) -> Column:
    """Evidence indexes. all: every one; heuristic: no question, and with a number or relation; mse: no question, and
    sharing a number with the first expression, else as heuristic. [0] if none is found."""
    every = indexes(F.size(sentences))
    at = lambda i: F.get(sentences, i)
    telling = lambda i: ~is_question(at(i)) & (has_number(at(i)) | has_relation_hint(at(i)))
    if mode == "all":
        return every
    if mode not in ("heuristic", "mse"):
        raise ValueError(f"unknown evidence mode {mode!r}")
    found = F.filter(every, telling)
    if mode == "mse":
        numbers = first_expression_numbers(expressions)
        shared = F.filter(every, lambda i: ~is_question(at(i)) & F.arrays_overlap(find_all(at(i), INTEGER), numbers))
        found = F.when(F.size(shared) > 0, shared).otherwise(found)
    return F.when(F.size(found) == 0, F.array(F.lit(0))).otherwise(found)


def clean_evidence(ids: Column, n: Column) -> Column:
    """Sorted distinct indexes before the question; [0] if none is left of two or more sentences."""
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 0) & (i < n - 1))))
    return F.when((F.size(own) == 0) & (n >= 2), F.array(F.lit(0))).otherwise(own)


def sentences_at(sentences: Column, ids: Column) -> Column:
    return F.transform(F.filter(ids, lambda i: (i >= 0) & (i < F.size(sentences))), lambda i: F.get(sentences, i))


# -- schema --


def lemma(word: Column) -> Column:
    low = F.lower(word)
    cut = lambda n: F.substring(low, F.lit(1), F.length(low) - n)
    return (
        F.when(F.endswith(low, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(low, F.lit("sses")) | F.endswith(low, F.lit("xes")), cut(2))
        .when(F.endswith(low, F.lit("s")) & ~F.endswith(low, F.lit("ss")), cut(1))
        .otherwise(low)
    )


# The patterns of units and of what each holder has.
COUNTED_UNIT, PER_UNIT = r"\b\d+\s+([A-Za-z]+s)\b", r"\bper\s+([A-Za-z]+)\b"
EACH_HAS = r"\beach\s+([A-Za-z]+)\s+(?:has|having|contains)\s+\d+\s+([A-Za-z]+)s\b"
EACH_HAS_LOOSE = r"each\s+([a-z]+)\s+(?:has|having|contains)\s+\d+\s+([a-z]+)s"


def units(question: Column) -> Column:
    found = F.concat(find_all(question, COUNTED_UNIT, 1), find_all(question, EACH_HAS, 1), find_all(question, EACH_HAS, 2), find_all(question, PER_UNIT, 1))
    return F.array_sort(F.array_except(F.array_distinct(F.transform(found, lemma)), words([*STOP_UNITS, ""])))


def forbidden_pairs(question: Column) -> Column:
    low = F.lower(question)
    both = F.zip_with(find_all(low, EACH_HAS_LOOSE, 2), find_all(low, EACH_HAS_LOOSE, 1), lambda a, b: F.concat(a, F.lit(" per "), b))
    return F.array_distinct(both)


def calc_chain(answer: Column) -> Column:
    """Struct of exprs, the plain arithmetic before each =, and final: the last #### text, else what the last = gives."""
    bodies = find_all(answer, CALCULATION, 1)
    final = strip(last(find_all(answer, FINAL_ANSWER, 1)))
    given = last(F.filter(bodies, lambda b: F.contains(b, F.lit("="))))
    fallback = strip(F.substring_index(given, "=", -1))
    left = F.transform(bodies, lambda b: strip(F.substring_index(b, "=", 1)))
    return F.struct(F.filter(left, lambda x: F.rlike(x, F.lit(r"(?U)^[0-9+\-*/().\s]+$"))).alias("exprs"), F.coalesce(F.when(final != "", final), fallback).alias("final"))


def calc_text(chain: Column) -> Column:
    """The chain as e1 ; e2 ; final=x."""
    return F.array_join(F.concat(chain.exprs, F.array(F.concat(F.lit("final="), F.coalesce(chain.final, F.lit(""))))), " ; ")


def final_answer(answer: Column, final: Column | None = None) -> Column:
    text = F.coalesce(answer, F.lit(""))
    own = strip(last(find_all(text, FINAL_ANSWER, 1)))
    given = F.when(strip(final) != "", strip(final)) if final is not None else F.lit(None).cast("string")
    return F.coalesce(given, own, strip(text))


def numbers_in(text: Column) -> Column:
    return find_all(text, NUMBER)


def core_numbers(text: Column) -> Column:
    """Distinct numbers, sorted as strings."""
    return F.array_sort(F.array_distinct(numbers_in(text)))


def core_words(text: Column) -> Column:
    """Distinct capitalised words, sorted, without sentence openers."""
    return F.array_sort(F.array_except(F.array_distinct(find_all(text, r"\b[A-Z][a-z]+\b")), words(NOT_CORE_WORDS)))


def content_tokens(text: Column) -> Column:
    return F.transform(F.filter(find_all(text, "[A-Za-z]+"), lambda w: F.length(w) >= 3), F.lower)


def feature_tokens(text: Column) -> Column:
    return F.transform(find_all(F.coalesce(text, F.lit("")), r"[A-Za-z0-9_./%-]+"), F.lower)


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != "")


def topic_hints(question: Column, unit_names: Column, k: int = 4) -> Column:
    """Units, then content words of the question, then general words: the first k."""
    own = F.array_distinct(F.transform(F.filter(unit_names, lambda u: strip(u) != ""), F.lower))
    more = F.filter(content_tokens(question), lambda w: ~F.array_contains(words(HINT_STOP_WORDS), w))
    return F.slice(F.array_distinct(F.concat(own, more, words(HINT_FALLBACK))), 1, k)


# -- noise constraints --


def mentions_any_word(text: Column, names: Column) -> Column:
    """Whether any of the words is in text, whole and in any case."""
    return F.exists(names, lambda w: F.rlike(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), F.lower(w), F.lit(r"\E\b"))))


def neutral_units_only(text: Column, unit_names: Column) -> Column:
    others = F.array_except(unit_names, words(NEUTRAL_UNITS))
    return ~mentions_any_word(text, others)


def paraphrase_like(sentence: Column, evidence: Column) -> Column:
    own = F.array_distinct(content_tokens(sentence))
    return (F.size(own) >= 2) & F.exists(evidence, lambda e: F.size(F.array_intersect(own, content_tokens(e))) >= 2)


def class_constraints(variant: str, sentence: Column, numbers: Column, names: Column, evidence: Column) -> Column:
    """Whether a noise sentence keeps to the rules of its variant; false for other variants."""
    own = numbers_in(sentence)
    different, hedged = contains_any(sentence, DIFFERENCE_MARKERS), contains_any(sentence, HEDGING_MARKERS)
    solving, asserting = contains_any(sentence, SOLVING_MARKERS), contains_any(sentence, ASSERTION_MARKERS)
    rules = {
        "TB": lambda: (F.size(own) == 0) & ~different & ~hedged & ~solving & ~mentions_any_word(sentence, names),
        "PED": lambda: different & (F.size(own) == 0) & ~hedged & ~mentions_any_word(sentence, names),
        "HU": lambda: hedged & ~different & (F.size(own) == 0) & ~asserting,
        "SP": lambda: (F.size(F.array_except(own, numbers)) == 0) & ~different & ~hedged & ~solving & paraphrase_like(sentence, evidence),
    }
    return rules[variant]() if variant in rules else F.lit(False)


def no_leakage(sentences: Column, answer: Column, pairs: Column) -> Column:
    """Whether the sentences, joined, hold neither the answer nor a pair."""
    low = F.lower(F.array_join(sentences, " "))
    own = F.lower(strip(answer))
    leaks = ((own != "") & F.contains(low, own)) | F.exists(pairs, lambda p: F.contains(low, F.lower(p)))
    return (low == "") | ~F.coalesce(leaks, F.lit(False))


# -- answers in free text --


def without_think_tags(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""))


def normal_expression(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")


def trace_text(trace: Column) -> Column:
    """Inputs of a call by ; and calls by |."""
    return F.array_join(F.transform(trace, lambda t: F.array_join(t.input, " ; ")), " | ")


def chain_steps(chain: Column) -> Column:
    """Steps of a chain text without its final= part."""
    return F.filter(F.transform(F.split(F.coalesce(chain, F.lit("")), ";"), strip), lambda s: (s != "") & ~F.startswith(s, F.lit("final=")))


# Names of elements that are no answers.
TAG_NAMES = ["answer", "result", "final_answer", "think", "reasoning", "expression"]


def tagged_answer(text: Column) -> Column:
    """Inside of the first <answer> element, else the last <value> that is no tag name; empty if none."""
    own = F.coalesce(text, F.lit(""))
    inner = strip(F.regexp_extract(own, r"(?is)<\s*answer\s*>\s*(.*?)\s*<\s*/\s*answer\s*>", 1))
    angled = F.filter(F.transform(find_all(own, r"<([^<>/]{1,80})>", 1), strip), lambda x: (x != "") & ~F.array_contains(words(TAG_NAMES), F.lower(x)))
    return F.coalesce(F.when(inner != "", inner), last(angled), F.lit(""))


def scalar_field(raw: Column, key: str, most: int = 200) -> Column:
    """A lenient key: value, quoted or up to a comma, brace or line end; at most `most` characters."""
    quoted = F.regexp_extract(raw, rf"""(?is)["']?{key}["']?\s*[:=]\s*"([^"]*)\"""", 1)
    bare = F.regexp_extract(raw, rf"""(?i)["']?{key}["']?\s*[:=]\s*["']?([^"',}}\n]+)""", 1)
    return F.substring(strip(F.coalesce(F.when(quoted != "", quoted), bare, F.lit(""))), 1, most)


def int_list_field(raw: Column, key: str) -> Column:
    """Integers within key: [...], whose bracket may be missing."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), rf"""(?is)["']?{key}["']?\s*[:=]\s*\[([^\]]*)""", 1)
    return F.transform(find_all(body, "-?[0-9]+"), lambda x: x.cast("int"))


def recovered_fields(raw: Column) -> Column:
    """Answer, evidence ids, reasoning and expression as far as they can be read from a broken reply."""
    answer = scalar_field(raw, "(?:final_answer|pred_answer)", 80)
    return F.struct(
        F.when(answer != "", answer).otherwise(tagged_answer(raw)).alias("pred_answer"),
        int_list_field(raw, "(?:pred_evidence_ids|evidence_ids)").alias("pred_evidence_ids"),
        scalar_field(raw, "reasoning", 400).alias("reasoning"),
        scalar_field(raw, "expression", 200).alias("expression"),
    )


def candidate_answer(text: Column) -> Column:
    """final_answer: x, else a tagged answer, else the last number, else empty."""
    own = F.coalesce(text, F.lit(""))
    named = strip(F.regexp_extract(own, r"""(?is)["']?final[_\s]?answer["']?\s*[:=]\s*["']?([^"',}\n]+)""", 1))
    tagged = strip(F.regexp_extract(own, r"(?is)<\s*(?:answer|result|final_answer)\s*>\s*([^<>]{1,80})\s*<\s*/\s*(?:answer|result|final_answer)\s*>", 1))
    return F.coalesce(F.when(named != "", named), F.when(tagged != "", tagged), last(find_all(own, SIGNED_NUMBER)), F.lit(""))


SIGNED_NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def xml_tool_calls(text: Column) -> Column:
    """(name, arguments as JSON) of each readable <tool_call>."""
    bodies = find_all(F.coalesce(text, F.lit("")), r"(?s)<tool_call>\s*(.*?)\s*</tool_call>", 1)
    return F.transform(
        F.filter(bodies, lambda b: F.get_json_object(b, "$").isNotNull() & F.startswith(b, F.lit("{"))),
        lambda b: F.struct(F.coalesce(F.get_json_object(b, "$.name"), F.lit("")).alias("name"), F.coalesce(F.get_json_object(b, "$.arguments"), F.lit("{}")).alias("arguments")),
    )


NOISE_PAYLOAD = "topic string, before array<string>, after array<string>"


def noise_payload(raw: Column) -> Column:
    """topic, before and after of a generator's JSON; blank sentences go, broken JSON gives empty ones."""
    own = F.from_json(raw, NOISE_PAYLOAD)
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: strip(F.coalesce(s, F.lit("")))), lambda s: s != "")
    return F.struct(strip(F.coalesce(own.topic, F.lit(""))).alias("topic"), clean(own.before).alias("before"), clean(own.after).alias("after"))


def fill_template(template: Column, **values: Column) -> Column:
    """{name} in template replaced by each value, null as empty."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)

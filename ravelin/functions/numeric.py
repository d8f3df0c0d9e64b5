"""Numbers, answers, evidence scores, hashes and small linear algebra as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.text import SIGNED_NUMBER, find_all, last, strip

TOLERANCE = 1e-9
EMPTY_DOUBLES = "array<double>"


def to_number(text: Column) -> Column:
    """The first number in text without commas, or null; infinite ones are null."""
    found = F.regexp_extract(F.replace(strip(text.cast("string")), F.lit(","), F.lit("")), "(?U)" + SIGNED_NUMBER, 0)
    value = found.try_cast("double")
    return F.when((found != "") & (F.abs(value) < float("inf")), value)


def whole_number(text: Column) -> Column:
    """text as a whole as a number, commas aside, or null."""
    own = F.replace(strip(text.cast("string")), F.lit(","), F.lit(""))
    return F.when(F.rlike(own, F.lit(rf"^(?:{SIGNED_NUMBER}|[-+]?[0-9]+\.)$")), own.try_cast("double"))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit("None"))), r"(?U)\s+", "")


def answers_equal(a: Column, b: Column) -> Column:
    x, y = to_number(a), to_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < TOLERANCE).otherwise(plain(a) == plain(b))


def truth_invariant(value: Column, answer: Column) -> Column:
    x, y = whole_number(value), whole_number(answer)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < TOLERANCE).otherwise(strip(value) == strip(answer)), F.lit(False))


def evidence_scores(pred: Column, gold: Column) -> Column:
    """Struct of precision, recall, f1 and exact, over sets of ids."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    hits = F.size(F.array_intersect(p, g)).cast("double")
    none = F.size(g) == 0
    precision = F.when(none, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).when(F.size(p) == 0, 0.0).otherwise(F.try_divide(hits, F.size(p)))
    recall = F.when(none, 1.0).otherwise(F.try_divide(hits, F.size(g)))
    f1 = F.when(none, precision).when(precision + recall == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    exact = F.array_sort(p) == F.array_sort(g)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), exact.alias("exact"))


def outcome(evidence_exact: Column, correct: Column, calc_used: Column) -> Column:
    return F.when(correct, "correct").when(~evidence_exact, "planning_error").when(calc_used, "expression_error").otherwise("compute_error")


def finite(value: Column, default: float = 0.0) -> Column:
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(default))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def last_number(text: Column) -> Column:
    """The last number of text as it stands, commas and all, or null."""
    return last(find_all(text, SIGNED_NUMBER)).try_cast("double")


def contains_number(text: Column, value: Column) -> Column:
    """Whether text holds value as a substring, or a number within the tolerance of it."""
    own = strip(F.coalesce(value, F.lit("")))
    x = to_number(own)
    near = F.exists(find_all(text, SIGNED_NUMBER), lambda n: F.abs(n.try_cast("double") - x) < TOLERANCE)
    return F.coalesce((own != "") & (F.contains(text, own) | F.coalesce(near, F.lit(False))), F.lit(False))


def complexity(expression: Column) -> Column:
    """Operators, separators and parentheses in an expression."""
    return F.regexp_count(F.coalesce(expression, F.lit("")), F.lit(r"[-+*/%^;|()]"))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow at either end."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


# -- stable hashes: MD5 as a 128-bit number --


def md5_half(text: Column, low: bool) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 17 if low else 1, 16), 16, 10).cast("decimal(20,0)")


def md5_mod(text: Column, k: int) -> Column:
    """The MD5 number modulo k, exactly, from its two halves; for a power of two its last digits tell."""
    if 2**28 % k == 0:
        return F.conv(F.substring(F.md5(text.cast("binary")), 26, 7), 16, 10).cast("int").bitwiseAND(k - 1)
    turn = 2**64 % k
    return F.pmod(F.pmod(md5_half(text, False), F.lit(k)) * turn + F.pmod(md5_half(text, True), F.lit(k)), F.lit(k)).cast("int")


def md5_bins(tokens: Column, k: int) -> Column:
    """The bins of tokens as one text, in order: a number of as many digits as k - 1 for each."""
    return F.array_join(F.array_sort(F.transform(tokens, lambda t: F.lpad(md5_mod(t, k).cast("string"), len(str(k - 1)), "0"))), "")


def problem_seed(key: Column, seed: int) -> Column:
    """seed plus the first eight hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") + seed


def bin_runs(at: Column, bins: int) -> Column:
    """A map from each bin in at, a text of md5_bins, to how often it is there: equal numbers stand together, so one pass finds their runs."""
    digits = len(str(bins - 1))
    runs = F.regexp_extract_all(at, F.lit(f"([0-9]{{{digits}}})\\1*"), F.lit(0))
    return F.map_from_arrays(F.transform(runs, lambda r: F.substring(r, F.lit(1), F.lit(digits)).cast("int")), F.transform(runs, lambda r: F.length(r) / digits))


def bin_counts(runs: Column, bins: int) -> Column:
    """How often each of 0 to bins - 1 occurs, from a map of bin_runs."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(runs, i), F.lit(0.0)))
    return F.when(F.size(runs) > 0, each).otherwise(F.array_repeat(F.lit(0.0), bins))


def scaled(values: Column, length: Column) -> Column:
    """values by their length; those of length 0 stay."""
    return F.when(length > 0, F.transform(values, lambda c: c / length)).otherwise(values)

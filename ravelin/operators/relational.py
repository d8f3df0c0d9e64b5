"""Keyed and ordered operators over tables: last wins, first-seen limits, strict joins, oversampling, pivots, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest order of each key. max_by is combined before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def first_seen(df: DataFrame, key: str, order: str, limit: int | None, offset: int = 0) -> DataFrame:
    """All rows of the keys that are, by their first place in order, the offset + 1st to offset + limit-th.

    A top-k over one row per key, not a window over all rows. A null limit keeps all after offset.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first", key)
    if limit is None and not offset:
        return df
    chosen = firsts.offset(offset) if limit is None else firsts.limit(offset + limit).offset(offset)
    chosen = chosen.select(F.col(key).alias("_key"))
    return df.join(chosen, df[key].eqNullSafe(F.col("_key")), "left_semi")


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right on keys; a row of left without a match fails the job."""
    marked = right.withColumn("_found", F.lit(True))
    joined = left.join(marked, keys, "left")
    checked = F.when(F.col("_found"), F.col(keys[0])).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no match for"), *[F.col(k).cast("string") for k in keys])).cast(left.schema[keys[0]].dataType))
    return joined.withColumn(keys[0], checked).drop("_found")


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Each row as many times as said; no times for less than one."""
    return df.withColumn("copy", F.explode(F.when(times >= 1, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))


def repeats_of(confidence: Column, source: Column) -> Column:
    """3 for strong, 2 for medium, else 1; one more for cot_fixable."""
    return F.when(confidence == "strong", 3).when(confidence == "medium", 2).otherwise(1) + F.when(source == "cot_fixable", 1).otherwise(0)


def exact_match_accuracy(pred: Column, gold: Column) -> Column:
    """Share of equal rows, null equal to null; 0 over no rows."""
    return F.coalesce(F.avg(F.equal_null(pred, gold).cast("double")), F.lit(0.0))


METRICS = {"exact_match_acc": exact_match_accuracy}


def compute_metrics(df: DataFrame, names: list[str], pred: str, gold: str) -> tuple[DataFrame, list[str]]:
    """One row of the known metrics by name, and the names that are unknown."""
    known = [n for n in names if n in METRICS]
    return df.agg(*[METRICS[n](F.col(pred), F.col(gold)).alias(n) for n in known] or [F.count("*").alias("n")]), [n for n in names if n not in METRICS]


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by a table of new names; others stay."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def binary_metrics(df: DataFrame, truth: str, pred: str, by: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """accuracy, precision, recall and f1 of 0/1 columns, for each by; each denominator is at least 1. times: how many rows a row stands for."""
    of = lambda c: F.count_if(c) if times is None else F.coalesce(F.sum(F.when(c, F.col(times))), F.lit(0))
    count = lambda t, p: of((F.col(truth) == t) & (F.col(pred) == p))
    c = df.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    ratio = lambda a, b: a / F.greatest(F.lit(1), b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    total = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.when(total == 0, 1.0).otherwise(total)))


def map_of_groups(df: DataFrame, key: str, name: str) -> DataFrame:
    """key and a map from name to the row's other columns, the last by name's order winning."""
    rest = [c for c in df.columns if c not in (key, name)]
    one = df.groupBy(key, name).agg(F.max(F.struct(*rest)).alias("_row"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, "_row"))).alias("rows"))


def accuracy_delta(summary: DataFrame, bases: dict[str, str], default: str) -> DataFrame:
    """Per mode and variant the accuracy against the base mode of that mode, in points; pairs on one side only go.

    summary: mode, variant, acc. bases: modes whose base is not the default.
    """
    base_of = F.create_map(*(F.lit(x) for pair in bases.items() for x in pair)) if bases else None
    own = summary.withColumn("base_mode", F.coalesce(F.try_element_at(base_of, F.col("mode")), F.lit(default)) if bases else F.lit(default))
    base = summary.select(F.col("mode").alias("base_mode"), "variant", F.col("acc").alias("base_acc"))
    return own.filter(F.col("mode") != F.col("base_mode")).join(base, ["base_mode", "variant"]).select("mode", "variant", "base_mode", ((F.col("acc") - F.col("base_acc")) * 100).alias("delta"))

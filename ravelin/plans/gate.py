"""Gates: weak labels from result tables, features, grouped folds, a class-mean linear model, and decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions import numeric, text
from ravelin.operators.relational import binary_metrics, last_per_key, must_match, oversample, repeats_of
from ravelin.sources.jsonl import stored

# Fixed values of the gates.
STEP_THRESHOLD, COMMIT_THRESHOLD = 0.05, 0.5
MOST_EXTRA_TURNS, MOST_ONE_MORE, MOST_CALLS_FOR_ONE_MORE = 3, 1, 2
FOLDS = 5
FEATURE_SPEC = {"type": "aug_v1", "text_bins": 64, "output_bins": 32, "expression_bins": 16}
UNCERTAIN = r"\b(?:maybe|might|possibly|not sure|uncertain|guess|probably|approximately|around)\b"
STEP_WORDS = r"\b(?:step\s*\d+|then|next|finally|after that|first|second|third)\b"
FEATURES = [
    "turn_index", "successful_calls", "error_count", "budget_remaining", "last_two_output_diff", "output_stagnation", "output_is_numeric", "last_output_magnitude",
    "pred_matches_last_success", "pred_matches_any_tool_output", "last_success_in_reasoning", "reasoning_lastnum_vs_last_success_diff", "pred_in_reasoning",
    "tool_output_in_reasoning_frac", "reasoning_length", "reasoning_step_count", "reasoning_has_uncertainty", "n_numbers_in_reasoning", "n_chunks_seen",
    "n_pred_evidence_ids", "evidence_coverage_ratio", "n_distinct_outputs", "all_outputs_same", "expression_complexity",
]
KEYS = ["id", "variant"]
#: The largest groups, whose sizes come to the driver.
HEAVY_GROUPS = 10_000


# -- features --


def outputs(trace: Column) -> Column:
    return F.transform(F.coalesce(trace, F.array().cast("array<struct<tool: string, input: array<string>, output: string, tool_call_id: string>>")), lambda t: text.strip(F.coalesce(t.output, F.lit(""))))


def successes(trace: Column) -> Column:
    """Outputs that are no error and no notice of the calculator; blank ones count."""
    return F.filter(outputs(trace), lambda o: ~(F.startswith(o, F.lit("Error")) | F.startswith(o, F.lit("[CALCULATOR"))))


def prepared(df: DataFrame) -> DataFrame:
    """Adds what the features share, as columns of their own: each is worked out once a row.

    _pred and _reasoning (stripped), _out and _good (outputs and successes), _last and _tail (of the successes).
    """
    own = df.withColumn("_pred", text.strip(F.coalesce("pred_answer", F.lit("")))).withColumn("_reasoning", text.strip(F.coalesce("reasoning", F.lit("")))).withColumn("_out", outputs(F.col("tool_trace")))
    own = own.withColumn("_good", F.filter("_out", lambda o: ~(F.startswith(o, F.lit("Error")) | F.startswith(o, F.lit("[CALCULATOR")))))
    return own.withColumn("_last", F.coalesce(text.last(F.col("_good")), F.lit(""))).withColumn("_tail", F.array_join(F.slice("_good", F.greatest(F.size("_good") - 2, F.lit(1)), 3), " ; "))


def feature_columns(*, n_chunks: Column, n_evidence: Column, expression: Column, limit: Column) -> dict[str, Column]:
    """The 24 numeric features by name, over a prepared table."""
    pred, reasoning, out, good, last = (F.col(c) for c in ("_pred", "_reasoning", "_out", "_good", "_last"))
    last_number = numeric.to_number(last)
    a, b = text.last(good, 2), text.last(good)
    two, same = F.size(good) >= 2, a == b
    x, y = numeric.to_number(a), numeric.to_number(b)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    number = lambda c: c.cast("double")
    reasoning_last = numeric.last_number(reasoning)
    inside = F.size(F.filter(good, lambda o: numeric.contains_number(reasoning, o)))
    distinct = F.size(F.array_distinct(good))
    words = F.size(F.filter(F.split(reasoning, r"(?U)\s+"), lambda w: w != ""))
    return {
        "turn_index": number(F.size(out)),
        "successful_calls": number(F.size(good)),
        "error_count": number(F.size(F.filter(out, lambda o: F.startswith(o, F.lit("Error"))))),
        "budget_remaining": number(F.greatest(F.lit(0), limit - F.size(out))),
        "last_two_output_diff": F.when(two & x.isNotNull() & y.isNotNull(), F.abs(x - y)).when(two & ~same, 1.0).otherwise(0.0),
        "output_stagnation": flag(two & same),
        "output_is_numeric": flag(last_number.isNotNull()),
        "last_output_magnitude": F.coalesce(F.abs(last_number), F.lit(0.0)),
        "pred_matches_last_success": flag((pred != "") & (last != "") & numeric.answers_equal(pred, last)),
        "pred_matches_any_tool_output": flag((pred != "") & F.exists(good, lambda o: numeric.answers_equal(pred, o))),
        "last_success_in_reasoning": flag(numeric.contains_number(reasoning, last)),
        "reasoning_lastnum_vs_last_success_diff": F.coalesce(F.abs(reasoning_last - last_number), F.lit(0.0)),
        "pred_in_reasoning": flag(numeric.contains_number(reasoning, pred)),
        "tool_output_in_reasoning_frac": numeric.safe_divide(number(inside), number(F.size(good))),
        "reasoning_length": number(words),
        "reasoning_step_count": number(F.regexp_count(reasoning, F.lit("(?iU)" + STEP_WORDS)) + F.regexp_count(reasoning, F.lit(";"))),
        "reasoning_has_uncertainty": flag(F.rlike(reasoning, F.lit("(?iU)" + UNCERTAIN))),
        "n_numbers_in_reasoning": number(F.size(text.find_all(reasoning, text.SIGNED_NUMBER))),
        "n_chunks_seen": number(n_chunks),
        "n_pred_evidence_ids": number(n_evidence),
        "evidence_coverage_ratio": number(n_evidence) / F.greatest(F.lit(1), n_chunks),
        "n_distinct_outputs": number(distinct),
        "all_outputs_same": flag(distinct == 1),
        "expression_complexity": number(numeric.complexity(expression)),
    }


def vector(columns: dict[str, Column], names: list[str] = FEATURES) -> Column:
    """Features in order; absent ones are 0."""
    return F.array(*[columns.get(n, F.lit(0.0)) for n in names])


def with_bags(df: DataFrame, bags: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds a hashed bag of words for each name: (text, bins). Bins of tokens are found and put in order once a row, then counted.

    Each column is used twice by the next, or the optimiser would put it into the function that runs for every bin.
    """
    df = df.withColumns({f"_{n}_at": numeric.md5_bins(text.feature_tokens(c), k) for n, (c, k) in bags.items()})
    df = df.withColumns({f"_{n}_runs": numeric.bin_runs(F.col(f"_{n}_at"), k) for n, (_, k) in bags.items()})
    df = df.withColumns({f"_{n}_count": numeric.bin_counts(F.col(f"_{n}_runs"), k) for n, (_, k) in bags.items()})
    df = df.withColumns({f"_{n}_length": F.sqrt(F.aggregate(f"_{n}_count", F.lit(0.0), lambda s, v: s + v * v)) for n in bags})
    return df.withColumns({n: numeric.scaled(F.col(f"_{n}_count"), F.col(f"_{n}_length")) for n in bags})


def with_step_features(df: DataFrame, name: str = "features", spec: dict = FEATURE_SPEC) -> DataFrame:
    """Adds 24 numbers, 64 bins of the candidate text and 32 of the last output: 120 in all.

    df: pred_answer, reasoning, tool_trace, n_chunks_seen, max_tool_calls_limit.
    """
    limit, n = F.coalesce("max_tool_calls_limit", F.lit(5)), F.coalesce("n_chunks_seen", F.lit(0))
    own = with_bags(prepared(df), {"_text": (F.col("reasoning"), spec["text_bins"]), "_output": (F.col("_last"), spec["output_bins"])})
    base = feature_columns(n_chunks=n, n_evidence=F.lit(0), expression=F.lit(""), limit=limit)
    return own.withColumn("_numbers", vector(base)).select(*[c for c in df.columns if c != name], F.concat("_numbers", "_text", "_output").alias(name))


def with_commit_features(df: DataFrame, name: str = "features", spec: dict = FEATURE_SPEC) -> DataFrame:
    """Adds 24 numbers, 64 bins of the reasoning, 32 of the last three outputs and 16 of the expression: 136 in all.

    df: also pred_evidence_ids and expression.
    """
    limit, n = F.coalesce("max_tool_calls_limit", F.lit(5)), F.coalesce("n_chunks_seen", F.lit(0))
    bags = {"_text": (F.col("reasoning"), spec["text_bins"]), "_output": (F.col("_tail"), spec["output_bins"]), "_written": (F.col("expression"), spec["expression_bins"])}
    own = with_bags(prepared(df), bags)
    base = feature_columns(n_chunks=n, n_evidence=F.size(F.coalesce("pred_evidence_ids", F.array().cast("array<int>"))), expression=F.col("expression"), limit=limit)
    return own.withColumn("_numbers", vector(base)).select(*[c for c in df.columns if c != name], F.concat("_numbers", "_text", "_output", "_written").alias(name))


# -- labels --


def keyed(df: DataFrame, order: str) -> DataFrame:
    """The last row of each (id, variant)."""
    return last_per_key(df, KEYS, order)


def _correct(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEYS, F.coalesce("answer_correct", F.lit(False)).alias(name))


def incomplete(trace: Column, calls: Column) -> Column:
    """Signs of an unfinished chain: at most one call, or an error."""
    return (F.coalesce(calls, F.lit(0)) <= 1) | F.exists(outputs(trace), lambda o: F.startswith(o, F.lit("Error")))


def _labelled(df: DataFrame, cases: list[tuple[Column, str, str, str]]) -> DataFrame:
    """label, label_source and label_confidence by the first case that holds."""
    pick = lambda k: reduce(lambda c, x: c.when(x[0], x[k]), cases[1:], F.when(cases[0][0], cases[0][k]))
    return df.withColumn("label", pick(1)).withColumn("label_source", pick(2)).withColumn("label_confidence", pick(3))


def step_labels_paper(baseline: DataFrame, cot: DataFrame) -> DataFrame:
    """baseline and cot are keyed; every baseline row must have its cot row."""
    own = baseline.withColumn("baseline_answer_correct", F.coalesce("answer_correct", F.lit(False)))
    df = must_match(own, _correct(cot, "cot_answer_correct"), KEYS)
    right, cot_right, few = F.col("baseline_answer_correct"), F.col("cot_answer_correct"), F.coalesce("tool_calls", F.lit(0)) < 2
    return _labelled(df, [(right, "commit", "baseline_correct", "strong"), (cot_right, "continue", "cot_fixable", "strong"), (few, "continue", "undercompute_heuristic", "medium"), (F.lit(True), "commit", "residual_commit", "weak")])


def step_labels(baseline: DataFrame) -> DataFrame:
    """From the baseline alone."""
    right, few = F.coalesce("answer_correct", F.lit(False)), F.coalesce("tool_calls", F.lit(0)) < 2
    return _labelled(baseline, [(right, "commit", "baseline_correct", ""), (few, "continue", "undercompute_heuristic", ""), (F.lit(True), "commit", "residual_commit", "")])


def _with_runs(baseline: DataFrame, cot: DataFrame, gated: DataFrame, fired: Column) -> DataFrame:
    runs = gated.select(*KEYS, F.coalesce("answer_correct", F.lit(False)).alias("gate_answer_correct"), fired.alias("gate_fired"))
    df = baseline.join(_correct(cot, "cot_answer_correct"), KEYS, "left").join(runs, KEYS, "left")
    return df.fillna(False, ["cot_answer_correct", "gate_answer_correct", "gate_fired"])


def step_labels_mixed(baseline: DataFrame, cot: DataFrame, gated: DataFrame) -> DataFrame:
    df = _with_runs(baseline, cot, gated, F.coalesce("gate_step_continue_count", F.lit(0)) > 0)
    right, cot_right, fired, gate_right = F.coalesce("answer_correct", F.lit(False)), F.col("cot_answer_correct"), F.col("gate_fired"), F.col("gate_answer_correct")
    few = F.coalesce("tool_calls", F.lit(0)) < 2
    cases = [(right, "commit", "baseline_correct"), (cot_right, "continue", "cot_fixable"), (fired & gate_right, "continue", "gate_fixed"), (fired, "commit", "gate_failed"), (few, "continue", "undercompute_heuristic"), (F.lit(True), "commit", "residual_commit")]
    return _labelled(df, [(*c, "") for c in cases])


def commit_labels(baseline: DataFrame) -> DataFrame:
    right, open_ = F.coalesce("answer_correct", F.lit(False)), incomplete(F.col("tool_trace"), F.col("tool_calls"))
    return _labelled(baseline, [(right, "submit", "baseline_correct", ""), (open_, "one_more_turn", "incomplete", ""), (F.lit(True), "fallback_cot", "residual", "")]).withColumn("binary_label", F.when(F.col("label") == "submit", "submit").otherwise("one_more_turn"))


def commit_labels_mixed(baseline: DataFrame, cot: DataFrame, gated: DataFrame) -> DataFrame:
    df = _with_runs(baseline, cot, gated, (F.coalesce("gate_one_more_used", F.lit(0)) > 0) | (F.coalesce("gate_step_continue_count", F.lit(0)) > 0))
    right, fired, gate_right = F.coalesce("answer_correct", F.lit(False)), F.col("gate_fired"), F.col("gate_answer_correct")
    open_ = incomplete(F.col("tool_trace"), F.col("tool_calls"))
    cases = [(right, "submit", "baseline_correct"), (F.col("cot_answer_correct"), "one_more_turn", "cot_fixable"), (fired & gate_right, "one_more_turn", "gate_fixed"), (fired, "submit", "gate_failed"), (open_, "one_more_turn", "incomplete"), (F.lit(True), "fallback_cot", "residual")]
    return _labelled(df, [(*c, "") for c in cases]).withColumn("binary_label", F.when(F.col("label") == "submit", "submit").otherwise("one_more_turn"))


# -- folds and model --


def fold(group: Column, k: int) -> Column:
    """Test fold of a group by the MD5 of its name."""
    return numeric.md5_mod(group.cast("string"), k)


def water_level(load: list[int], more: int) -> float:
    """The level up to which `more` fills the least of load."""
    low = sorted(load)
    for n in range(1, len(low) + 1):
        level = (sum(low[:n]) + more) / n
        if n == len(low) or level <= low[n]:
            return level
    return 0.0


def balanced_folds(df: DataFrame, group: str, k: int = FOLDS, heavy: int = HEAVY_GROUPS, times: str | None = None) -> DataFrame:
    """(group, fold): min(k, number of groups) folds of near-equal numbers of rows; null is a group. times: how many rows a row stands for.

    Groups are taken by size, the largest first, then by name. The first `heavy` ones go each to the fold with the fewest rows so far. The others stand in that
    order over the partitions of a range shuffle, and their running sum tells which fold's room they fall into, so a fold is off by the size of one of them at most.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    spark, order = df.sparkSession, [F.desc("n"), F.asc("_group")]
    sizes = stored(sizes, "sizes")
    facts = sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    load, out = [0] * max(1, min(k, facts.groups)), []
    for r in sizes.orderBy(*order).limit(heavy).collect():
        at = min(range(len(load)), key=lambda i: (load[i], i))
        load[at] += r.n
        out.append((r[0], at))
    first = spark.createDataFrame(out, T.StructType([df.schema[group]]).add("fold", T.IntegerType()))
    if facts.groups <= heavy:
        return first
    rest = sizes.join(F.broadcast(first), F.col("_group").eqNullSafe(first[group]), "left_anti")
    rest = stored(rest.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    level, rows_left = water_level(load, facts.rows - sum(load)), 0
    starts = {}
    for r in rest.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():  # a row for each partition
        starts[r[0]], rows_left = rows_left, rows_left + r.n
    bounds = [sum(max(0.0, level - x) for x in load[: i + 1]) for i in range(len(load) - 1)]
    before = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_part"))
    middle = before + F.sum("n").over(Window.partitionBy("_part").orderBy(*order)) - F.col("n") / 2
    return first.union(rest.withColumn("_at", middle).select("_group", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_at"))).alias("fold")))


@dataclass
class LinearGate:
    """Logistic score of a linear function of the features."""

    TYPE = "linear_gate_model_v1"
    weights: list[float]
    bias: float
    classes_: list[int] = field(default_factory=lambda: [0, 1])

    def decision(self, x: Column) -> Column:
        return numeric.dot(x, F.array(*map(F.lit, self.weights))) + self.bias

    def probability(self, x: Column) -> Column:
        return numeric.sigmoid(self.decision(x))

    def predict(self, x: Column) -> Column:
        return (self.probability(x) >= 0.5).cast("int")

    def to_dict(self) -> dict:
        return {"type": self.TYPE, "weights": self.weights, "bias": self.bias, "classes_": self.classes_}

    @classmethod
    def from_dict(cls, d: dict) -> LinearGate:
        return cls([float(w) for w in d["weights"]], float(d["bias"]), list(d.get("classes_", [0, 1])))


def mean_vectors(df: DataFrame, features: str = "features", label: str = "y", by: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """(by, label, mean, n): the mean of the feature vectors of each class and their number, by one aggregate over vectors. times: how many rows a row stands for."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    weight = F.col(times).cast("double") if times else F.lit(1.0)
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(features)), weight))
    return df.filter(F.col(features).isNotNull()).groupBy(*by, label).agg(mean.alias("mean"), F.sum(weight).alias("n"))


def class_means(df: DataFrame, features: str = "features", label: str = "y") -> DataFrame:
    """(label, pos, mean) of each feature in each class."""
    return mean_vectors(df, features, label).select(label, F.posexplode("mean").alias("pos", "mean"))


def between(means: dict[int, list[float]]) -> LinearGate:
    """Weights from class 0's mean to class 1's, and the bias half-way; with one class weights of 0 and a bias of 8 or -8."""
    if len(means) < 2:
        return LinearGate([0.0] * max(map(len, means.values()), default=0), 8.0 if 1 in means else -8.0)
    low, high = means[0], means[1]
    weights = [b - a for a, b in zip(low, high, strict=True)]
    return LinearGate(weights, -sum(w * (a + b) for w, a, b in zip(weights, low, high, strict=True)) / 2)


def fit_linear(df: DataFrame, features: str = "features", label: str = "y") -> LinearGate:
    """The gate between the class means of all rows."""
    return between({int(r[label]): r["mean"] for r in mean_vectors(df, features, label).collect()})  # two rows


def fit_linear_folds(samples: DataFrame, folds: list[int]) -> tuple[dict[int, LinearGate], LinearGate]:
    """A linear gate without each fold, and that of all, from one pass: the means of a fold and class are weighed by its rows."""
    parts = mean_vectors(samples, by=("fold",), times="copies").collect()  # two rows a fold

    def without(fold: int | None) -> LinearGate:
        means = {}
        for y in {int(r.y) for r in parts if r.fold != fold}:
            own = [r for r in parts if r.y == y and r.fold != fold]
            n = sum(r.n for r in own)
            means[y] = [sum(r.n * x for r, x in zip(own, xs, strict=True)) / n for xs in zip(*(r["mean"] for r in own), strict=True)]
        return between(means)

    return {f: without(f) for f in folds}, without(None)


def _optional(df: DataFrame) -> DataFrame:
    """df with the result columns that features read and old files lack."""
    kinds = {"pred_answer": "string", "reasoning": "string", "n_chunks_seen": "int", "max_tool_calls_limit": "int", "pred_evidence_ids": "array<int>", "expression": "string"}
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def with_folds(samples: DataFrame, k: int = FOLDS) -> DataFrame:
    """samples with the fold of their id, each counted as often as copies says."""
    folds = balanced_folds(samples, "id", k, times="copies").withColumnRenamed("id", "_id")
    return samples.join(folds, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")


def _samples(labelled: DataFrame, y: Column, copies: Column, featured: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features are worked out once, after the joins, so that none is shuffled. Rows are short and their features are not, so all partitions share the work."""
    own = stored(_optional(labelled).withColumn("y", y.cast("int")).withColumn("copies", copies), "labelled")
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(featured(with_folds(own).repartition(parts, *[c for c in KEYS if c in own.columns])), "samples")


def step_samples(labelled: DataFrame) -> DataFrame:
    """Labelled step rows with features, y (1 for continue), copies, by confidence, and the fold of their id."""
    return _samples(labelled, F.col("label") == "continue", repeats_of(F.col("label_confidence"), F.col("label_source")), with_step_features)


def commit_samples(labelled: DataFrame) -> DataFrame:
    return _samples(labelled, F.col("binary_label") == "one_more_turn", F.lit(1), with_commit_features)


def probability(model: LinearGate, x: Column) -> Column:
    return model.probability(x) if model.weights else F.lit(float(model.bias > 0))


def with_probability(df: DataFrame, model, features: str = "features", name: str = "p") -> DataFrame:
    """df with the probability of class 1 by a linear gate or a fitted Spark ML pipeline."""
    if isinstance(model, LinearGate):
        return df.withColumn(name, probability(model, F.col(features)))
    return model.transform(df.withColumnRenamed(features, "features") if features != "features" else df).withColumnRenamed("p", name)


def fit(df: DataFrame, family: str = "linear", seed: int = 42) -> tuple[object, str]:
    """A model of rows (id, y, features), and the family that it is of: linear where a perceptron has but one class to learn from."""
    if family == "linear":
        return fit_linear(df), family
    from ravelin.plans.estimator import PerceptronEstimator

    model = PerceptronEstimator(seed=seed).fit(df)
    return model, "linear_fallback" if len(model.stages) == 1 else family


def train(samples: DataFrame, positive: str, label_mode: str, k: int = FOLDS, family: str = "linear") -> dict:
    """Metrics of grouped folds, and a model of all samples; a row counts as often as copies says. A single group has no fold to learn from, and no metrics."""
    firsts = "copy = 1" if "copy" in samples.columns else "true"  # where copies are rows of their own
    samples = samples if "copies" in samples.columns else samples.withColumn("copies", F.lit(1))
    samples = samples if "fold" in samples.columns else stored(with_folds(samples, k), "samples")
    groups = samples.agg(F.count_distinct("id")).first()[0]
    parts = samples.groupBy("fold").agg(F.sum("copies").alias("n"), F.sum(F.col("y") * F.col("copies")).alias("positive")).collect()
    sizes, n = {r.fold: r.n for r in parts}, sum(r.n for r in parts)
    own_folds, scores = sorted(sizes) if len(sizes) > 1 else [], []
    if family == "linear":
        models, model = fit_linear_folds(samples, own_folds)
        backend = family
        if own_folds:
            p = F.coalesce(*[F.when(F.col("fold") == f, probability(m, F.col("features"))) for f, m in models.items()])
            test = samples.select("fold", "y", "copies", (p >= 0.5).cast("int").alias("pred"))
            scores = [r.asDict() for r in binary_metrics(test, "y", "pred", ("fold",), "copies").collect()]
    else:
        repeated = oversample(samples, F.col("copies"))
        for f in own_folds:
            part, _ = fit(repeated.filter(F.col("fold") != f), family, 42 + f)
            test = with_probability(samples.filter(F.col("fold") == f), part).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
            scores.append(binary_metrics(test, "y", "pred", times="copies").first().asDict() | {"fold": f})
        model, backend = fit(repeated, family)
    scores = [s | {"n_train": n - sizes[s["fold"]], "n_test": sizes[s["fold"]]} for s in sorted(scores, key=lambda s: s["fold"])]
    sources = {r.label_source: r["count"] for r in samples.filter(firsts).groupBy("label_source").count().collect()}
    width = samples.select(F.size("features").alias("n")).first()
    return {"model": model, "backend": backend, "positive_class": positive, "feature_dim": width.n if width else 0, "feature_spec": FEATURE_SPEC, "label_mode": label_mode, "n_samples": n, "n_positive": sum(r.positive or 0 for r in parts) if parts else None, "n_groups": groups, "label_sources": sources, "folds": scores}


def train_step(baseline: DataFrame, cot: DataFrame | None = None, gated: DataFrame | None = None, label_mode: str = "paper", family: str = "linear") -> dict:
    """Step gate; the paper labels need cot, mixed ones cot and gated."""
    if label_mode == "paper" and cot is None:
        raise ValueError("paper labels need chain-of-thought results")
    labelled = step_labels_paper(baseline, cot) if label_mode == "paper" else step_labels_mixed(baseline, cot, gated) if label_mode == "mixed" else step_labels(baseline)
    return train(step_samples(labelled), "continue", label_mode, family=family)


def train_commit(baseline: DataFrame, cot: DataFrame | None = None, gated: DataFrame | None = None, label_mode: str = "paper", family: str = "linear") -> dict:
    mode = ("mixed" if cot is not None else "off-policy") if label_mode == "paper" else label_mode
    labelled = commit_labels_mixed(baseline, cot, gated if gated is not None else baseline.limit(0)) if mode == "mixed" else commit_labels(baseline)
    return train(commit_samples(labelled), "one_more_turn", mode, family=family)


# -- decisions --


def step_decision(p: Column, n_calls: Column, limit: Column, extra_turns: Column, threshold: float = STEP_THRESHOLD, most_extra: int = MOST_EXTRA_TURNS) -> Column:
    """Struct of action and p_continue: commit with 0 out of turns or calls, else continue from the threshold on."""
    out = (extra_turns >= most_extra) | (n_calls >= limit)
    return F.struct(F.when(~out & (p >= threshold), "continue").otherwise("commit").alias("action"), F.when(out, 0.0).otherwise(p).alias("p_continue"))


def commit_decision(p: Column, pred: Column, trace: Column, one_more_used: Column, threshold: float = COMMIT_THRESHOLD, most: int = MOST_ONE_MORE, safe: bool = True, most_calls: int = MOST_CALLS_FOR_ONE_MORE) -> Column:
    """Struct of action and p_one_more: submit with 0 out of turns, else one more turn from the threshold on unless a veto holds."""
    out, good = one_more_used >= most, successes(trace)
    n = F.size(outputs(trace))
    last = F.coalesce(text.last(good), F.lit(""))
    stuck = (F.size(good) >= 2) & ((text.last(good) == text.last(good, 2)) | (F.size(F.array_distinct(good)) == 1))
    many = (n > most_calls) & ~F.exists(outputs(trace), lambda o: F.startswith(o, F.lit("Error")))
    own = text.strip(F.coalesce(pred, F.lit("")))
    wrong = (own != "") & (last != "") & numeric.answers_equal(own, last) & (n >= 2) & stuck
    veto = F.coalesce(many | wrong, F.lit(False)) if safe else F.lit(False)
    return F.struct(F.when(~out & (p >= threshold) & ~veto, "one_more_turn").otherwise("submit").alias("action"), F.when(out, 0.0).otherwise(p).alias("p_one_more"))

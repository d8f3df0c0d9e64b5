"""Mechanism ablation: problems by conditions, the mock solver, scores, summaries and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import numeric, text
from ravelin.functions.calc import calculate_steps
from ravelin.operators.relational import accuracy_delta, first_seen
from ravelin.plans import gate
from ravelin.sources.jsonl import replace_values, upsert

CONDITION = "mode string, tool_mode string, max_tool_calls int, oracle_evidence boolean, force_tool_first_turn boolean, step_gate boolean, commit_gate boolean"
# The conditions, their base for differences, and the mock solver's words.
CONDITIONS = [
    ("fc_baseline", "real", 5, False, True, False, False),
    ("fc_auto", "real", 5, False, False, False, False),
    ("fc_noop", "noop", 5, False, True, False, False),
    ("fc_auto_noop", "noop", 5, False, False, False, False),
    ("fc_perfect", "perfect", 5, False, True, False, False),
    ("fc_max1", "real", 1, False, True, False, False),
    ("fc_oracle_ev", "real", 5, True, True, False, False),
    ("fc_notool_cot", "notool", 5, False, True, False, False),
    ("fc_notool_fcprompt", "fcprompt", 5, False, True, False, False),
]
STEP_CONDITIONS = [("gate_step", "real", 5, False, True, True, False), ("gate_step_critic", "real", 5, False, True, True, False)]
COMMIT_CONDITIONS = [("gate_commit_only", "real", 5, False, True, False, True), ("gate_step_commit", "real", 5, False, True, True, True)]
BASELINE, OTHER_BASES = "fc_baseline", {"fc_auto_noop": "fc_noop"}
MOCK_REASONING = "Mock backend used the gold evidence and a deterministic answer path for smoke-test verification."
OFFLINE = "[CALCULATOR OFFLINE] Mock backend skipped external computation."
TOOL_MODES = {"real", "noop", "perfect", "notool", "fcprompt"}


@dataclass(frozen=True)
class AgentConfig:
    """One condition as an agent sees it."""

    mode: str
    tool_mode: str
    max_tool_calls: int = 5
    oracle_evidence: bool = False
    force_tool_first_turn: bool = True

    def __post_init__(self) -> None:
        if self.tool_mode not in TOOL_MODES:
            raise ValueError(f"unknown tool mode {self.tool_mode!r}")


def conditions(spark: SparkSession, step_gate: bool = False, extended: bool = False, only: list[str] | None = None) -> DataFrame:
    """The condition table; gates' conditions need their gate, and an unknown name in `only` is an error."""
    rows = CONDITIONS + (STEP_CONDITIONS if step_gate else []) + (COMMIT_CONDITIONS if extended else [])
    if unknown := set(only or []) - {r[0] for r in rows}:
        raise ValueError(f"unknown conditions: {', '.join(sorted(unknown))}")
    return spark.createDataFrame([r for r in rows if not only or r[0] in only], CONDITION)


def chunks(sentences: Column, evidence: Column, noise: Column, variant: Column) -> Column:
    """(index, text, is_evidence, is_noise, is_question, noise_type) of each sentence; the last is the question."""
    n = F.size(sentences)

    def chunk(s: Column, i: Column) -> Column:
        noisy = F.array_contains(noise, i)
        return F.struct(i.alias("index"), s.alias("text"), F.array_contains(evidence, i).alias("is_evidence"), noisy.alias("is_noise"), (i == n - 1).alias("is_question"), F.when(noisy, variant).alias("noise_type"))

    return F.transform(sentences, chunk)


def info_chunks(chunk: Column, kind: str = "all") -> Column:
    """All but the question, or of those evidence or noise alone."""
    fits = {"all": lambda c: ~c.is_question, "evidence": lambda c: c.is_evidence & ~c.is_question, "noise": lambda c: c.is_noise & ~c.is_question}[kind]
    return F.filter(chunk, fits)


def by_hash(chunk: Column, key: Column, seed: int) -> Column:
    """Chunks in an order that key and seed fix."""
    keyed = F.transform(chunk, lambda c: F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), key, c.index.cast("string")).cast("binary")).alias("h"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x.c)


def retrieve(chunk: Column, key: Column, k: int, seed: int = 42, guarantee_evidence: bool = False) -> Column:
    """k chunks in a seeded order; with the guarantee, up to a third are evidence, taken in text order."""
    pool = info_chunks(chunk)
    if not guarantee_evidence:
        return F.slice(by_hash(pool, key, seed), 1, k)
    evidence = F.slice(F.filter(pool, lambda c: c.is_evidence), 1, max(1, k // 3))
    others = by_hash(F.filter(pool, lambda c: ~c.is_evidence), key, seed)
    return F.slice(F.concat(evidence, others), 1, k)


def retrieve_all(chunk: Column, key: Column | None = None, seed: int | None = None) -> Column:
    """All chunks but the question, in text order or, with a seed, in a seeded one."""
    pool = info_chunks(chunk)
    return pool if seed is None else by_hash(pool, key, seed)


def load_problems(benchmark: DataFrame, variants: list[str] | None = None, limit: int | None = None, offset: int = 0, order: str = "seq") -> DataFrame:
    """Benchmark rows as problems: variants by their canonical names, ids by their first place, gold answer and chunks."""
    df = benchmark.withColumn("variant", text.canonical_variant(F.col("variant")))
    if variants:
        names = [text.VARIANT_ALIASES.get(v, v) or "base" for v in variants]
        df = df.filter(F.col("variant").isin(names))
    df = first_seen(df, "id", order, limit, offset)
    sentences = F.col("question_sentences")
    evidence = F.array_sort(F.col("evidence_sentence_ids"))
    return df.select(
        "id",
        "variant",
        F.get(sentences, F.size(sentences) - 1).alias("question_text"),
        text.final_answer(F.col("answer"), F.col("schema.calc_chain.final")).alias("gold_answer"),
        F.col("meta.calc_chain").alias("calc_chain"),
        evidence.alias("gold_evidence_ids"),
        chunks(sentences, evidence, F.col("noise_sentence_ids"), F.col("variant")).alias("chunks"),
    )


def crossed(problems: DataFrame, table: DataFrame) -> DataFrame:
    """Every problem under every condition: a product with a table of fixed size, as an array in each row."""
    rows = table.collect()  # the condition table, of some 13 rows
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(table.schema[c].dataType).alias(c) for c in table.columns]) for r in rows])
    return problems.withColumn("_condition", F.explode(each)).select(*problems.columns, "_condition.*")


def mock_solved(df: DataFrame, step_model: gate.LinearGate | None = None, commit_model: gate.LinearGate | None = None) -> DataFrame:
    """The mock solver's answers: the gold ones, by a call of the calculator where the condition has one."""
    steps = text.chain_steps(F.col("calc_chain"))
    gold = F.coalesce(F.col("gold_answer"), F.lit("None"))
    worked = F.when(F.size("_steps") > 0, calculate_steps(F.when(F.size("_steps") > 0, F.col("_steps")).otherwise(F.array(F.lit("0"))))).otherwise(gold)
    output = F.when(F.col("tool_mode") == "noop", OFFLINE).when(F.col("tool_mode") == "perfect", gold).otherwise(F.col("_worked"))
    call = F.struct(F.lit("calculator").alias("tool"), F.col("_steps").alias("input"), output.alias("output"), F.lit("mock_tool_call_0").alias("tool_call_id"))
    df = df.withColumn("_steps", steps).withColumn("_worked", worked)
    calls = F.when(F.col("tool_mode").isin("real", "perfect", "noop"), F.array(call)).otherwise(F.array(call).cast("array<struct<tool: string, input: array<string>, output: string, tool_call_id: string>>"))
    calls = F.slice(calls, 1, F.when(F.col("tool_mode").isin("real", "perfect", "noop"), 1).otherwise(0))
    df = df.select(
        *[c for c in df.columns if not c.startswith("_")],
        gold.alias("pred_answer"),
        F.col("gold_evidence_ids").alias("pred_evidence_ids"),
        F.lit(MOCK_REASONING).alias("reasoning"),
        F.array_join("_steps", " ; ").alias("expression"),
        calls.alias("tool_trace"),
        F.size(info_chunks(F.col("chunks"))).alias("n_chunks_seen"),
        F.size("_steps").alias("n_steps"),
    )
    return gated(df, step_model, commit_model).drop("n_steps")


def gated(df: DataFrame, step_model: gate.LinearGate | None, commit_model: gate.LinearGate | None) -> DataFrame:
    """Adds the gates' verdicts for conditions that have one; without a gate it submits."""
    names, real, limit = df.columns, F.col("tool_mode") == "real", F.col("max_tool_calls")
    df = df.withColumn("max_tool_calls_limit", limit)
    none = F.struct(F.lit("commit").alias("action"), F.lit(0.0).alias("p_continue"))
    submit = F.struct(F.lit("submit").alias("action"), F.lit(0.0).alias("p_one_more"))
    step, commit = none, submit
    if step_model:
        df = gate.with_step_features(df, "_step_x").withColumn("_step_p", step_model.probability(F.col("_step_x")))
        step = F.when(real & F.col("step_gate"), gate.step_decision(F.col("_step_p"), F.size("tool_trace"), limit, F.lit(0))).otherwise(none)
    if commit_model:
        df = gate.with_commit_features(df, "_commit_x").withColumn("_commit_p", commit_model.probability(F.col("_commit_x")))
        commit = F.when(real & F.col("commit_gate"), gate.commit_decision(F.col("_commit_p"), F.col("pred_answer"), F.col("tool_trace"), F.lit(0))).otherwise(submit)
    return df.withColumn("_step", step).withColumn("_commit", commit).select(
        *names,
        F.col("_commit.action").alias("gate_action"),
        F.col("_step.p_continue").alias("gate_p_continue"),
        F.col("_commit.p_one_more").alias("gate_p_one_more"),
        F.lit(False).alias("gate_anchor_applied"),
        F.when(F.col("_commit.action") == "one_more_turn", 1).otherwise(0).alias("gate_one_more_used"),
        F.when(F.col("_step.action") == "continue", 1).otherwise(0).alias("gate_step_continue_count"),
        F.lit(0).alias("gate_step_no_progress_blocks"),
        F.lit(0).alias("gate_step_duplicate_blocks"),
    )


def scored(df: DataFrame) -> DataFrame:
    """Result rows: correctness and evidence scores, which are full where the evidence was given."""
    s, oracle = numeric.evidence_scores(F.col("pred_evidence_ids"), F.col("gold_evidence_ids")), F.col("oracle_evidence")
    full = lambda c: F.when(oracle, 1.0).otherwise(c)
    gates = [c for c in df.columns if c.startswith("gate_")]
    return df.withColumn("_s", s).select(
        "id", "variant", "mode", "pred_answer", "gold_answer",
        numeric.answers_equal(F.col("pred_answer"), F.col("gold_answer")).alias("answer_correct"),
        "pred_evidence_ids", "gold_evidence_ids",
        full(F.col("_s.precision")).alias("evidence_precision"), full(F.col("_s.recall")).alias("evidence_recall"), full(F.col("_s.f1")).alias("evidence_f1"),
        (oracle | F.col("_s.exact")).alias("evidence_exact_match"),
        "n_chunks_seen", F.size("tool_trace").alias("tool_calls"), "tool_trace", "expression", "reasoning", "tool_mode", "oracle_evidence",
        F.col("max_tool_calls").alias("max_tool_calls_limit"), *gates,
    )


def summary(results: DataFrame) -> DataFrame:
    """Per mode and variant, and per mode as _overall: accuracy, mean calls, evidence F1 and rows, unrounded. One aggregation of both levels."""
    out = results.groupingSets([["mode", "variant"], ["mode"]], "mode", "variant").agg(
        F.avg(F.col("answer_correct").cast("double")).alias("acc"), F.avg("tool_calls").alias("avg_tool_calls"), F.avg("evidence_f1").alias("evidence_f1"), F.count("*").alias("n"), F.grouping("variant").alias("_all")
    )
    detail = lambda c: F.when(F.col("_all") == 0, F.col(c)).alias(c)
    return out.select("mode", F.when(F.col("_all") == 1, "_overall").otherwise(F.col("variant")).alias("variant"), "acc", detail("avg_tool_calls"), detail("evidence_f1"), "n")


def rounded(summary_rows: DataFrame) -> DataFrame:
    """The summary as reports show it."""
    return summary_rows.select("mode", "variant", F.round("acc", 4).alias("acc"), F.round("avg_tool_calls", 3).alias("avg_tool_calls"), F.round("evidence_f1", 4).alias("evidence_f1"), "n")


def error_report(results: DataFrame) -> DataFrame:
    """Per mode/variant: rows, accuracies, and over rows with a trace the rates of error kinds and mean calls."""
    traced = F.col("tool_trace").isNotNull()
    kind = numeric.outcome(F.coalesce("evidence_exact_match", F.lit(False)), F.coalesce("answer_correct", F.lit(False)), F.size("tool_trace") > 0)
    rate = lambda k: F.avg(F.when(traced, F.when(kind == k, 1.0).otherwise(0.0))).alias(f"{k}_rate")
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return results.groupBy(F.concat_ws("/", "mode", "variant").alias("setting")).agg(
        F.count("*").alias("n"), mean("answer_correct").alias("answer_acc"), mean("evidence_f1").alias("evidence_f1_mean"), mean("evidence_exact_match").alias("evidence_em_acc"),
        rate("planning_error"), rate("expression_error"), rate("compute_error"), F.avg(F.when(traced, F.size("tool_trace"))).alias("avg_tool_calls"),
    )


def tool_stats(trace: Column) -> Column:
    """Struct of n_tool_calls, n_calc_errors and calc_used."""
    out = gate.outputs(trace)
    n = F.size(out)
    return F.struct(n.alias("n_tool_calls"), F.size(F.filter(out, lambda o: F.startswith(o, F.lit("Error")))).alias("n_calc_errors"), (n > 0).alias("calc_used"))


def accuracy_table(results: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """Accuracy in percent by mode, a column for each variant and one overall."""
    correct = F.col("answer_correct").cast("double") * 100
    by = results.groupBy("mode").pivot("variant", variants or text.VARIANTS).agg(F.avg(correct))
    return by.join(results.groupBy("mode").agg(F.avg(correct).alias("overall")), "mode")


def deltas(results: DataFrame) -> DataFrame:
    own = results.groupBy("mode", "variant").agg(F.avg(F.col("answer_correct").cast("double")).alias("acc"))
    return accuracy_delta(own, OTHER_BASES, BASELINE)


def run(benchmark: DataFrame, *, only: list[str] | None = None, variants: list[str] | None = None, limit: int | None = None, offset: int = 0, step_model: gate.LinearGate | None = None, commit_model: gate.LinearGate | None = None, order: str = "seq") -> DataFrame:
    """Result rows of the mock solver for all problems under all conditions."""
    table = conditions(benchmark.sparkSession, step_gate=step_model is not None, extended=commit_model is not None, only=only)
    problems = load_problems(benchmark, variants, limit, offset, order)
    return scored(mock_solved(crossed(problems, table), step_model, commit_model))


def merged(existing: DataFrame, new: DataFrame, only: list[str]) -> tuple[DataFrame, DataFrame]:
    """One condition's rows with new ones in place of old, and the combined table with whole conditions replaced."""
    return upsert(existing, new, ["id", "variant"]), replace_values(existing, new, "mode", only)

"""Benchmark generation: problems to schema, evidence, noise, validation, and a row for each variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.functions import numeric, text
from ravelin.functions.calc import recomputed

# The default plan and the sentences of the mock generator.
DEFAULT_PLAN = {"defaults": {"before": 2, "after": 2}, "per_variant": {}, "max_total_per_variant": 8}
BACKGROUND = [
    "People often keep notes on {topic}.",
    "General trends in {topic} can change over time.",
    "Background details on {topic} do not determine the answer by themselves.",
    "Related reports on {topic} describe the setting without affecting the math.",
]
PARALLEL = [
    "In another case, Mason handled a separate set of items.",
    "Elsewhere, Nora worked on a different task for another group.",
    "In a nearby setting, Liam prepared supplies for a separate event.",
    "Different people often completed unrelated versions of the same activity.",
]
HEDGED = [
    "It is said that the earlier notes might have been reviewed later.",
    "Some say the situation was possibly discussed after the fact.",
    "Reportedly, the record may have been checked more than once.",
    "It is possible that someone mentioned the details again afterward.",
]
NO_IDS = "array<int>"


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def counts_for(plan: dict | None, variant: str) -> tuple[int, int]:
    """Noise sentences before and after: the variant's numbers or the defaults; what is over the cap is taken off after."""
    plan = plan or DEFAULT_PLAN
    defaults, own = plan.get("defaults", {}), (plan.get("per_variant") or {}).get(variant, {})
    before, after = (int(own.get(k, defaults.get(k, 2))) for k in ("before", "after"))
    cap = int(plan.get("max_total_per_variant", 8))
    return max(0, before), max(0, min(after, max(0, cap - before)))


def with_schema(df: DataFrame) -> DataFrame:
    """Adds schema: units, pairs and calc_chain."""
    return df.withColumn("schema", F.struct(text.units(F.col("question")).alias("units"), text.forbidden_pairs(F.col("question")).alias("pairs"), text.calc_chain(F.col("answer")).alias("calc_chain")))


def with_core(df: DataFrame, mode: str = "heuristic") -> DataFrame:
    """Adds core_sentences, the question last, and evidence_sentence_ids."""
    core = df.withColumn("_sentences", text.split_sentences(F.col("question"))).withColumn("core_sentences", text.question_last(F.col("_sentences"))).drop("_sentences")
    return core.withColumn("evidence_sentence_ids", text.pick_evidence(F.col("core_sentences"), mode, F.col("schema.calc_chain.exprs")))


def mock_noise(variant: str, sentences: Column, before: int, after: int) -> Column:
    """The mock generator's noise of one variant as an array of (type, position, text)."""
    n = before + after
    if variant == "TB":
        topic = F.when(F.contains(F.lower(F.array_join(sentences, " ")), F.lit("bookmark")), "bookmark sales").otherwise("school supplies")
        bank = F.array(*[F.replace(F.lit(s), F.lit("{topic}"), topic) for s in BACKGROUND])
    elif variant == "SP":
        own = F.transform(F.filter(text.drop_last(sentences), lambda s: s != ""), lambda s: F.replace(F.replace(s, F.lit("Then "), F.lit("After that, ")), F.lit("How many"), F.lit("Determine how many")))
        times = F.when(F.size(own) > 0, F.ceil(F.lit(n) / F.size(own)).cast("int")).otherwise(0)
        bank = F.flatten(F.array_repeat(own, F.greatest(times, F.lit(1))))
    else:
        bank = text.words({"PED": PARALLEL, "HU": HEDGED}[variant])
    item = lambda position: lambda s: F.struct(F.lit(variant).alias("type"), F.lit(position).alias("position"), s.alias("text"))
    return F.concat(F.transform(F.slice(bank, 1, before), item("before")), F.transform(F.slice(bank, before + 1, after), item("after")))


def with_noise(df: DataFrame, plan: dict | None = None, variants: list[str] | None = None) -> DataFrame:
    """Adds the mock generator's noise in place of any there was, and meta.gen_raw with what each variant was made from."""
    variants = text.NOISY_VARIANTS if variants is None else [v for v in variants if v in text.NOISY_VARIANTS]
    sentences = F.col("core_sentences")
    names = F.array_join(text.core_words(F.col("question")), ", ")
    numbers = F.array_join(text.core_numbers(F.col("question")), ", ")
    noise = F.concat(*[mock_noise(v, sentences, *counts_for(plan, v)) for v in variants]) if variants else empty(schemas.NOISE)
    raw = F.struct(F.lit(None).cast("string").alias("error"), names.alias("core_words"), numbers.alias("core_numbers"))
    gen_raw = F.map_from_arrays(text.words(variants), F.array(*[raw] * len(variants))) if variants else F.create_map().cast("map<string, struct<error: string, core_words: string, core_numbers: string>>")
    return df.withColumn("noise", noise).withColumn("meta", F.struct(gen_raw.alias("gen_raw")))


def of_variant(noise: Column, variant: str, position: str | None = None) -> Column:
    """Texts of a variant's noise items at a position; items of other positions or blank texts do not count."""
    fits = lambda n: (n.type == variant) & (n.position == position if position else n.position.isin("before", "after")) & (text.strip(n.text) != "")
    return F.transform(F.filter(noise, fits), lambda n: text.strip(n.text))


def validated(df: DataFrame) -> DataFrame:
    """Adds validated_noises, the checks of each variant's sentences, and meta_checks. Nothing is dropped: the checks are advice."""
    question, variants = F.col("question"), text.NOISY_VARIANTS
    made = lambda v: F.try_element_at(F.col("meta.gen_raw"), F.lit(v))
    own = df.withColumns(
        {
            "_evidence": text.sentences_at(F.col("core_sentences"), F.col("evidence_sentence_ids")),
            "_answer": text.final_answer(F.col("answer"), F.col("schema.calc_chain.final")),
            "_numbers": text.core_numbers(question),
            "_names": text.core_words(question),
            **{f"_noise_{v}": of_variant(F.col("noise"), v) for v in variants},
            **{f"_numbers_{v}": text.comma_list(made(v).core_numbers) for v in variants},
            **{f"_names_{v}": text.comma_list(made(v).core_words) for v in variants},
        }
    )
    or_else = lambda a, b: F.when(F.size(a) > 0, F.col(a)).otherwise(F.col(b))
    own = own.withColumns({f"_numbers_{v}": or_else(f"_numbers_{v}", "_numbers") for v in variants} | {f"_names_{v}": or_else(f"_names_{v}", "_names") for v in variants})

    def checks(v: str) -> Column:
        ok = F.forall(F.col(f"_noise_{v}"), lambda s: text.class_constraints(v, s, F.col(f"_numbers_{v}"), F.col(f"_names_{v}"), F.col("_evidence")))
        return F.struct(ok.alias("class_constraints"), text.no_leakage(F.col(f"_noise_{v}"), F.col("_answer"), F.col("schema.pairs")).alias("no_leakage"))

    own = own.withColumns({f"_checks_{v}": checks(v) for v in variants}).withColumn("_value", recomputed(F.col("schema.calc_chain")))
    noises = F.map_from_arrays(text.words(variants), F.array(*[F.col(f"_checks_{v}") for v in variants]))
    some = F.map_filter(noises, lambda v, _: F.exists(F.col("noise"), lambda n: n.type == v))
    return own.select(*df.columns, some.alias("validated_noises"), F.struct(numeric.truth_invariant(F.col("_value"), F.col("_answer")).alias("truth_invariant")).alias("meta_checks"))


def row_layout(core: Column, before: Column, after: Column) -> Column:
    """before, evidence, after and question, with the indexes of evidence and noise."""
    n, b, a = F.size(core), F.size(before), F.size(after)
    evidence = F.transform(text.indexes(n - 1), lambda i: i + b)
    position = F.when((b > 0) & (a > 0), "both").when(b > 0, "before").when(a > 0, "after")
    return F.struct(
        F.concat(before, text.drop_last(core), after, F.slice(core, -1, 1)).alias("question_sentences"),
        evidence.alias("evidence_sentence_ids"),
        F.array_except(text.indexes(n - 1 + b + a), evidence).alias("noise_sentence_ids"),
        b.alias("n_before"),
        a.alias("n_after"),
        position.alias("position"),
    )


def assembled(df: DataFrame, variants: list[str] | None = None, calc_text: bool = True) -> DataFrame:
    """A row for the base and each variant with noise; problems without a sentence go.

    df: core_sentences, noise, schema and any columns of its own. In every row all sentences but the
    question are evidence.
    """
    variants = text.NOISY_VARIANTS if variants is None else [v for v in variants if v in text.NOISY_VARIANTS]
    given = F.when(F.size("core_sentences") > 0, F.col("core_sentences")).otherwise(text.split_sentences(F.col("question")))
    none = empty("array<string>")
    named = lambda v, layout: F.struct(F.lit(v).alias("variant"), layout.alias("layout"))
    clash = [c for c in df.columns if c in {"_given", "_row", *(f"_{p}_{v}" for v in variants for p in ("before", "after"))}]
    if clash:
        raise ValueError(f"columns of these names are needed here: {', '.join(clash)}")
    own = df.withColumn("_given", given).withColumn("core_sentences", text.question_last(F.col("_given"))).withColumns({f"_{p}_{v}": of_variant(F.col("noise"), v, p) for v in variants for p in ("before", "after")})
    core = F.col("core_sentences")
    rows = F.array(named("base", row_layout(core, none, none)), *[named(v, row_layout(core, F.col(f"_before_{v}"), F.col(f"_after_{v}"))) for v in variants])
    kept = F.filter(rows, lambda r: (F.size(core) > 0) & ((r.variant == "base") | (r.layout.n_before + r.layout.n_after > 0)))
    layout = ["question_sentences", "evidence_sentence_ids", "noise_sentence_ids", "n_before", "n_after", "position"]
    static = [c for c in dict.fromkeys([*df.columns, "core_sentences"]) if c not in {*layout, "variant", "noise", "meta"}]
    meta = F.struct((text.calc_text(F.col("schema.calc_chain")) if calc_text else F.lit(None).cast("string")).alias("calc_chain"))
    # explode alone would have the optimiser copy all of the above into a filter below it
    return own.select(*static, meta.alias("meta"), F.explode_outer(kept).alias("_row")).filter("_row is not null").select(*static, "meta", "_row.variant", "_row.layout.*")


def generate(raw: DataFrame, mode: str = "heuristic", plan: dict | None = None, variants: list[str] | None = None) -> dict[str, DataFrame]:
    """All stages by name, each a table that could be written."""
    stages = {"schema": with_schema(raw)}
    stages["core"] = with_core(stages["schema"], mode)
    stages["noise"] = with_noise(stages["core"], plan, variants)
    stages["validated"] = validated(stages["noise"])
    stages["benchmark"] = assembled(stages["validated"], variants)
    return stages

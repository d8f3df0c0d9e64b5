import json

import pytest
from problems import BASELINE, COT, RAW, call, result
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.operators import relational as R
from ravelin.plans import ablation, gate, generation


@pytest.fixture(scope="module")
def stages(spark):
    return generation.generate(spark.createDataFrame(RAW, schemas.RAW))


@pytest.fixture(scope="module")
def results(spark):
    table = lambda rows: spark.read.schema(schemas.RESULT).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
    return table(BASELINE).cache(), table(COT).cache()


def by_id(df):
    return {r.id[-1]: r for r in df.collect()}


def test_schema_and_core(stages):
    s = by_id(stages["core"])
    assert [list(s[k].schema.units) for k in "012"] == [["apple"], ["box", "pen"], ["bottle", "crate"]]
    assert list(s["2"].schema["pairs"]) == ["bottle per crate"] and s["0"].schema.calc_chain.exprs == ["14/2", "14+7"] and s["1"].schema.calc_chain.final == "36"
    assert [s[k].evidence_sentence_ids for k in "012"] == [[0], [0, 1], [0, 1]]


def test_noise_and_validation(stages):
    v = by_id(stages["validated"])
    assert all(set(v[k].validated_noises) == {"TB", "PED", "HU", "SP"} and v[k].meta_checks.truth_invariant for k in "012")
    assert all(v["0"].validated_noises[n].class_constraints and v["0"].validated_noises[n].no_leakage for n in ("TB", "PED", "HU"))
    assert not v["1"].validated_noises["SP"].class_constraints  # "each" is a solving word
    again = generation.with_noise(stages["noise"]).select("id", F.size("noise")).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in stages["noise"].select("id", F.size("noise")).collect()}


@pytest.mark.parametrize("plan, variant, want", [(None, "TB", (2, 2)), ({"defaults": {"before": 3, "after": 3}, "max_total_per_variant": 4}, "TB", (3, 1)), ({"per_variant": {"HU": {"before": 9}}, "max_total_per_variant": 4}, "HU", (9, 0)), ({"per_variant": {"HU": {"after": 1}}}, "HU", (2, 1))])
def test_counts(plan, variant, want):
    assert generation.counts_for(plan, variant) == want


def test_rows(stages):
    rows = {(r.id[-1], r.variant): r for r in stages["benchmark"].collect()}
    assert len(rows) == 15
    base, tb, long = rows["0", "base"], rows["0", "TB"], rows["1", "HU"]
    assert (base.evidence_sentence_ids, base.noise_sentence_ids, base.n_before, base.position) == ([0], [], 0, None)
    assert (tb.evidence_sentence_ids, tb.noise_sentence_ids, tb.n_before, tb.n_after, tb.position) == ([2], [0, 1, 3, 4], 2, 2, "both")
    assert (long.evidence_sentence_ids, long.noise_sentence_ids) == ([2, 3], [0, 1, 4, 5]) and long.question_sentences[-1].endswith("?")
    assert base.meta.calc_chain == "14/2 ; 14+7 ; final=21"


def test_single_sentence_and_empty(spark):
    df = spark.createDataFrame([("a", "How many?", "1"), ("b", "", "2"), ("c", None, None)], schemas.RAW)
    rows = [(r.id, r.variant, r.n_before, r.n_after) for r in generation.generate(df)["benchmark"].collect()]
    assert {r[:2] for r in rows} == {("a", "base"), ("a", "TB"), ("a", "PED"), ("a", "HU")}


def test_mock_ablation(stages):
    rows = stages["benchmark"].withColumn("seq", F.col("id"))
    out = ablation.run(rows).cache()
    assert out.count() == 15 * 9 and out.filter("not answer_correct or evidence_f1 <> 1").count() == 0
    calls = {r.tool_mode: r.n for r in out.groupBy("tool_mode").agg(F.max("tool_calls").alias("n")).collect()}
    assert calls == {"real": 1, "noop": 1, "perfect": 1, "notool": 0, "fcprompt": 0}
    assert ablation.run(rows, limit=1, only=["fc_noop"]).count() == 5 and ablation.run(rows, limit=1, offset=5).count() == 0
    assert {r.id for r in ablation.run(rows, variants=["LX"], limit=1, offset=1, only=["fc_noop"]).collect()} == {"own/train/1"}
    s = {(r.mode, r.variant): r for r in ablation.summary(out).collect()}
    assert s["fc_noop", "_overall"].n == 15 and s["fc_noop", "_overall"].avg_tool_calls is None and s["fc_max1", "TB"].acc == 1.0
    assert ablation.rounded(ablation.summary(out)).count() == len(s)
    assert all(r.delta == 0 for r in ablation.deltas(out).collect()) and ablation.accuracy_table(out).count() == 9
    new = out.filter("mode = 'fc_noop' and variant = 'TB'").withColumn("answer_correct", F.lit(False))
    one, whole = ablation.merged(out.filter("mode = 'fc_noop'"), new, ["fc_noop"])
    assert one.count() == 15 and one.filter("not answer_correct").count() == 3
    with pytest.raises(ValueError):
        ablation.conditions(rows.sparkSession, only=["nothing"])
    with pytest.raises(ValueError):
        ablation.AgentConfig("x", "magic")


def test_step_labels(results):
    b, c = results
    got = {r.id[-1]: (r.label, r.label_source, r.label_confidence) for r in gate.step_labels_paper(b, c).collect()}
    assert got == {
        "0": ("continue", "cot_fixable", "strong"), "1": ("commit", "baseline_correct", "strong"), "2": ("continue", "cot_fixable", "strong"),
        "3": ("commit", "residual_commit", "weak"), "4": ("commit", "baseline_correct", "strong"), "5": ("continue", "undercompute_heuristic", "medium"),
    }
    assert sorted(r.label for r in gate.step_labels(b).collect()) == ["commit"] * 3 + ["continue"] * 3
    with pytest.raises(Exception, match="no match for own/5"):
        gate.step_labels_paper(b, c.filter("id <> 'own/5'")).collect()


def test_commit_labels(spark, results):
    b, c = results
    assert {r.id[-1]: r.label for r in gate.commit_labels(b).collect()} == {"0": "one_more_turn", "1": "submit", "2": "one_more_turn", "3": "one_more_turn", "4": "submit", "5": "one_more_turn"}
    g = b.withColumn("gate_step_continue_count", F.lit(1)).withColumn("answer_correct", F.col("id") == "own/3")
    got = {r.id[-1]: (r.label, r.binary_label) for r in gate.commit_labels_mixed(b, c, g).collect()}
    assert got["3"] == ("one_more_turn", "one_more_turn") and got["5"] == ("submit", "submit") and got["0"][0] == "one_more_turn"
    assert {r.id[-1]: r.label for r in gate.step_labels_mixed(b, c, g).collect()}["5"] == "commit"


def test_training(spark, results, tmp_path):
    from ravelin.sources.jsonl import read_artifact, write_artifact

    b, c = results
    a = gate.train_step(b, c)
    assert (a["n_samples"], a["n_positive"], a["feature_dim"], a["label_mode"]) == (4 + 3 + 4 + 1 + 3 + 2, 4 + 4 + 2, 120, "paper") and a["folds"]
    assert gate.train_commit(b)["feature_dim"] == 136 and gate.train_commit(b, c)["label_mode"] == "mixed"
    write_artifact(spark, a, f"{tmp_path}/gate.json")
    back = read_artifact(spark, f"{tmp_path}/gate.json")
    assert back["model"] == a["model"]
    x = gate.with_step_features(b).select(back["model"].probability(F.col("features")).alias("p"), F.size("features").alias("n")).collect()
    assert all(0 <= r.p <= 1 and r.n == 120 for r in x)
    with pytest.raises(ValueError):
        read_artifact(spark, "model.pkl")
    with pytest.raises(ValueError):
        gate.train_step(b)


def test_features(spark):
    trace = [call("3", "1+2"), call("Error: x"), call("[CALCULATOR OFFLINE]"), call(" 4 "), call("4")]
    rows = [result(4, "TB", True, 5, trace) | {"reasoning": "First 3; then maybe 4.", "expression": "(1+2)*3"}, result(5, "TB", True, 0) | {"reasoning": None, "pred_answer": None}]
    df = spark.read.schema(schemas.RESULT).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
    f = gate.feature_columns(n_chunks=F.lit(6), n_evidence=F.lit(2), expression=F.col("expression"), limit=F.lit(5))
    got, none = gate.prepared(df).select(*[f[n].alias(n) for n in gate.FEATURES]).collect()
    assert got.asDict() == {
        "turn_index": 5, "successful_calls": 3, "error_count": 1, "budget_remaining": 0, "last_two_output_diff": 0, "output_stagnation": 1, "output_is_numeric": 1, "last_output_magnitude": 4,
        "pred_matches_last_success": 1, "pred_matches_any_tool_output": 1, "last_success_in_reasoning": 1, "reasoning_lastnum_vs_last_success_diff": 0, "pred_in_reasoning": 1,
        "tool_output_in_reasoning_frac": 1, "reasoning_length": 5, "reasoning_step_count": 3, "reasoning_has_uncertainty": 1, "n_numbers_in_reasoning": 2, "n_chunks_seen": 6,
        "n_pred_evidence_ids": 2, "evidence_coverage_ratio": 2 / 6, "n_distinct_outputs": 2, "all_outputs_same": 0, "expression_complexity": 4,
    }
    assert none.reasoning_length == 0 and none.last_output_magnitude == 0 and none.budget_remaining == 5 and none.all_outputs_same == 0


def test_hashed_bags(spark):
    import hashlib

    df = gate.with_bags(spark.createDataFrame([("one two one",), ("",), (None,)], "t string"), {"bag": (F.col("t"), 16)})
    got = [r.bag for r in df.collect()]
    want = [0.0] * 16
    for w in ("one", "two", "one"):
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 16] += 1
    size = sum(x * x for x in want) ** 0.5
    assert got[0] == pytest.approx([x / size for x in want]) and got[1] == got[2] == [0.0] * 16


def test_linear_gate(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([3.0, 0.0], 1), ([5.0, 2.0], 1)], "features array<double>, y int")
    m = gate.fit_linear(df)
    assert m.weights == [3.0, 1.0] and m.bias == -(3 * 5 + 1 * 1) / 2 and gate.LinearGate.from_dict(m.to_dict()) == m
    assert gate.fit_linear(df.filter("y = 1")).bias == 8.0 and gate.fit_linear(df.limit(0)).bias == -8.0
    p = spark.range(1).select(gate.numeric.sigmoid(F.lit(-800.0)), gate.numeric.sigmoid(F.lit(800.0))).first()
    assert tuple(p) == (0.0, 1.0)


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("a", 3, 7), ("c", 4, 8), (None, 5, 9)], "k string, seq int, v int")
    assert {r.k: r.v for r in R.last_per_key(df, ["k"], "seq").collect()} == {"a": 7, "b": 6, "c": 8, None: 9}
    assert sorted(r.v for r in R.first_seen(df, "k", "seq", 2, 1).collect()) == [6, 8] and R.first_seen(df, "k", "seq", None, 3).count() == 1
    assert {tuple(r) for r in R.first_seen(df, "k", "seq", None).collect()} == {tuple(r) for r in df.collect()}
    assert R.oversample(df, F.col("seq") - 1).count() == 0 + 1 + 2 + 3 + 4
    m, unknown = R.compute_metrics(df, ["exact_match_acc", "bleu"], "seq", "v")
    assert m.first().exact_match_acc == 0.0 and unknown == ["bleu"] and R.compute_metrics(df.limit(0), ["exact_match_acc"], "seq", "v")[0].first()[0] == 0.0
    assert R.renamed(df, {"v": "w"}).columns == ["k", "seq", "w"]

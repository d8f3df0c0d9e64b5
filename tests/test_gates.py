import json

import numpy as np
import pytest
from problems import call, result
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ravelin import cli, schemas
from ravelin.plans import estimator, gate
from ravelin.sources import jsonl


def loads(df, folds, group="g"):
    own = df.join(folds.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    return sorted(r["count"] for r in own.groupBy("fold").count().collect())


def test_folds_of_few_groups(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 4), (None, 3), ("d", 2), ("e", 2)) for _ in range(n)], "g string")
    got = {r.g: r.fold for r in gate.balanced_folds(df, "g", 2).collect()}
    assert got == {"a": 0, "b": 1, None: 1, "d": 0, "e": 0} or loads(df, gate.balanced_folds(df, "g", 2)) == [7, 9]
    assert {r.fold for r in gate.balanced_folds(df, "g", 9).collect()} == set(range(5))
    assert [tuple(r) for r in gate.balanced_folds(df.filter("g = 'a'"), "g").collect()] == [("a", 0)]
    assert gate.balanced_folds(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("heavy", [0, 3, 50])
def test_folds_by_running_sums(spark, heavy):
    rows = [(f"g{k:04d}",) for k, n in enumerate(np.random.default_rng(heavy).zipf(1.6, 400).clip(1, 300)) for _ in range(n)]
    df = spark.createDataFrame(rows + [(None,)], "g string")
    folds = gate.balanced_folds(df, "g", 4, heavy)
    got = loads(df, folds)
    sizes = sorted((r["count"] for r in df.groupBy("g").count().collect()), reverse=True)
    assert folds.count() == folds.select("g").distinct().count() == len(sizes) and sum(got) == len(rows) + 1
    assert max(got) <= max(sum(sizes) / 4 + sizes[heavy], sizes[0])


def test_folds_of_a_million_groups(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("g")).withColumn("n", F.when(F.col("g") % 1000 == 0, 50).when(F.col("g") % 3 == 0, 2).otherwise(1)).select("g", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    got = loads(df, gate.balanced_folds(df, "g", 5, heavy=500))
    assert len(got) == 5 and max(got) < 1.01 * min(got)


def test_water_level():
    assert gate.water_level([0, 0, 0], 9) == 3 and gate.water_level([10, 0, 1], 3) == 2 and gate.water_level([5], 5) == 10 and gate.water_level([4, 4, 0], 12) == 20 / 3


def test_means_by_one_aggregate(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([3.0, 4.0], 0), ([5.0, 6.0], 1), (None, 1)], "features array<double>, y int")
    means = gate.mean_vectors(df)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and {r.y: r["mean"] for r in means.collect()} == {0: [2.0, 3.0], 1: [5.0, 6.0]}


def samples(spark, n=120):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no linear gate can tell
    return spark.createDataFrame([(f"q{k}", x[k].tolist(), int(y[k]), "s", 1) for k in range(n)], "id string, features array<double>, y int, label_source string, copy int")


def test_both_estimators_are_kept(spark, tmp_path):
    rows = samples(spark)
    perceptron, linear = estimator.PerceptronEstimator(hidden=[8], maxIter=60, step=15).fit(rows), estimator.LinearGateEstimator().fit(rows)
    right = lambda m: m.transform(rows).filter(F.col("prediction") == F.col("y")).count()
    assert right(perceptron) > 105 > right(linear) and set(perceptron.transform(rows).columns) == {*rows.columns, "p", "prediction"}
    for name, model in (("p", perceptron), ("l", linear)):
        model.write().overwrite().save(f"{tmp_path}/{name}")
        back = PipelineModel.load(f"{tmp_path}/{name}")
        assert [r.p for r in back.transform(rows).orderBy("id").collect()] == [r.p for r in model.transform(rows).orderBy("id").collect()]
    learner = estimator.PerceptronEstimator(step=5)
    learner.write().overwrite().save(f"{tmp_path}/e")
    assert estimator.PerceptronEstimator.load(f"{tmp_path}/e").getOrDefault("step") == 5


def test_training_stops_early(spark):
    # labels by chance: more training only fits the noise, so the loss on held-out groups soon rises
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"q{k}", draw.normal(size=4).tolist(), int(draw.integers(2))) for k in range(80)], "id string, features array<double>, y int")
    losses = []
    real = estimator.PerceptronEstimator.loss
    watched = type("Watched", (estimator.PerceptronEstimator,), {"loss": staticmethod(lambda m, r: losses.append(real(m, r)) or losses[-1])})
    model = watched(hidden=[16], maxIter=400, step=10, validation=30).fit(rows)
    assert 3 <= len(losses) < 40 and len(model.stages) == 4 and losses[-1] > min(losses) - 1e-4
    held = spark.createDataFrame([("a", [0.0], 1)] * 3, "id string, features array<double>, y int")
    assert len(watched().fit(held).stages) == 1


def test_training_with_either_family(spark, tmp_path):
    rows = samples(spark, 60)
    found = gate.train(rows, "continue", "paper", 3, "perceptron")
    assert found["backend"] == "perceptron" and len(found["folds"]) == 3 and sum(f["n_test"] for f in found["folds"]) == 60
    assert all(f["n_train"] + f["n_test"] == 60 for f in found["folds"])
    jsonl.write_artifact(spark, found, f"{tmp_path}/g.json")
    back = jsonl.read_artifact(spark, f"{tmp_path}/g.json")
    p = lambda m: [r.p for r in gate.with_probability(rows, m).orderBy("id").collect()]
    assert p(back["model"]) == p(found["model"]) and back["folds"] == found["folds"]
    one = gate.train(rows.withColumn("y", F.lit(1)), "continue", "paper", 3, "perceptron")
    assert one["backend"] == "linear_fallback" and min(p(one["model"])) > 0.99
    alone = gate.train(rows.withColumn("id", F.lit("q")), "continue", "paper")
    assert alone["folds"] == [] and alone["n_groups"] == 1


def test_copies_count_as_rows_without_being_rows(spark):
    rows = samples(spark, 60).drop("copy").withColumn("copies", F.length("id") - 1)
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    one, many = gate.train(rows, "continue", "paper", 4), gate.train(repeated, "continue", "paper", 4)
    assert one["model"].weights == pytest.approx(many["model"].weights) and one["model"].bias == pytest.approx(many["model"].bias)
    assert {k: v for k, v in one.items() if k != "model"} == {k: v for k, v in many.items() if k != "model"} and one["n_samples"] == 110
    folds = {r._id: r.fold for r in gate.balanced_folds(repeated, "id", 4).withColumnRenamed("id", "_id").collect()}
    own = rows.withColumn("fold", F.udf(folds.get, "int")("id"))
    for f in one["folds"]:
        by_hand = gate.fit_linear(repeated.join(own.select("id", "fold"), "id").filter(F.col("fold") != f["fold"]))
        test = gate.with_probability(own.filter(F.col("fold") == f["fold"]), by_hand).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
        assert f["tp"] == test.filter("y = 1 and pred = 1").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]


def test_training_reads_features_in_few_passes(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("passes", "training")
    rows = gate.stored(gate.with_folds(samples(spark, 60).drop("copy").withColumn("copies", F.lit(3))), "samples")
    before = len(tracker.getJobIdsForGroup("passes"))
    gate.train(rows, "continue", "paper")
    jobs = len(tracker.getJobIdsForGroup("passes")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 14  # not some for each fold


def test_gates_of_two_classes_on_the_command_line(spark, tmp_path):
    rows = [result(k, "TB", k % 2 == 0, 1 + k % 3, [call(str(k))]) | {"reasoning": "fine" if k % 2 == 0 else "maybe not"} for k in range(12)]
    rows += [r | {"mode": "fc_notool_cot", "answer_correct": True} for r in rows]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    cli.main(["gates", "--in", f"{tmp_path}/r.jsonl", "--out", f"{tmp_path}/g", "--family", "perceptron"])
    found = jsonl.read_artifact(spark, f"{tmp_path}/g/g_step.json")
    assert found["backend"] == "perceptron" and 0 < found["n_positive"] < found["n_samples"] and len(found["folds"]) == 5
    own = gate.with_step_features(spark.read.schema(schemas.RESULT).json(f"{tmp_path}/r.jsonl").filter("mode = 'fc_baseline'"))
    assert {(r.p >= 0.5) == (r.answer_correct is False) for r in gate.with_probability(own, found["model"]).collect()} == {True}

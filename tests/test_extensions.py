import datetime
import os
import random
import time

import numpy as np
import pyarrow.compute as pc
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import calc, jsonrepair, phrases
from ravelin.operators import aggregates, tables
from ravelin.operators import relational as R
from ravelin.plans import catalogue, generation
from ravelin.streaming import progress

SF = "/root/testdata/sf0.001"


def played(spark, folder, name, batches):
    """Rows of the stream over files of batches, one file a batch, in order; a query of its own goes on with each."""
    source = f"{folder}/{name}-in"
    os.makedirs(source)
    calls = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        q = progress.progress(calls).writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start(f"{folder}/{name}-out")
        assert q.awaitTermination(120)
        out.append(spark.read.schema(progress.OUT).parquet(f"{folder}/{name}-out").count())
    return sorted(map(tuple, spark.read.schema(progress.OUT).parquet(f"{folder}/{name}-out").collect())), out


def test_progress_whatever_the_batches(spark, tmp_path):
    progress.configure(spark)
    events = spark.read.parquet(f"{SF}/events.parquet").filter("user_id < 6").withColumn("output", F.floor("value").cast("string")).select("user_id", "ts", "event_id", "event_type", "output")
    cuts = [r.ts for r in events.orderBy("ts").collect()][::25]
    split = [events.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, [*cuts[1:], datetime.datetime(9999, 1, 1)], strict=True)][:3]
    split[-1] = events.filter(F.col("ts") >= cuts[2])
    rows, counts = played(spark, tmp_path, "three", split)
    want = catalogue.QUERIES["progress_markers"](spark, SF).join(events.select("event_id"), "event_id").select("event_id", "duplicate", "last_success", "n_success")
    assert rows == sorted(map(tuple, want.collect())) and counts == sorted(set(counts)) and len(counts) == 3


def test_idle_users_are_forgotten(spark, tmp_path):
    progress.configure(spark)
    row = lambda user, k: spark.createDataFrame([(user, k, k, "click", "7")], "user_id long, ts long, event_id long, event_type string, output string").coalesce(1)
    source = f"{tmp_path}/in"
    os.makedirs(source)
    calls = spark.readStream.schema(row(1, 1).schema).parquet(source)
    q = progress.progress(calls, 1_000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start(f"{tmp_path}/out")
    try:
        for k, batch in enumerate([row(1, 1), row(1, 2)], 1):
            batch.write.mode("append").parquet(source)
            until = time.time() + 90
            while time.time() < until and (not os.path.exists(f"{tmp_path}/out/_spark_metadata") or spark.read.schema(progress.OUT).parquet(f"{tmp_path}/out").count() < k):
                time.sleep(0.3)
            time.sleep(6)  # batches without rows tell that the timer is over
    finally:
        q.stop()
    assert sorted(map(tuple, spark.read.schema(progress.OUT).parquet(f"{tmp_path}/out").collect())) == [(1, False, "7", 1), (2, False, "7", 1)]


def test_table_functions(spark):
    tables.register(spark)
    rows = [("a", ["Then Mia has 3 pens.", "How many?"]), ("b", ["How many?"]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "id string, core_sentences array<string>")
    got = spark.sql("SELECT * FROM noise_rows(TABLE({df}), array('TB', 'PED', 'HU', 'SP', 'none'), 3, 2)", df=df).collect()
    made = generation.with_noise(df.withColumn("question", F.lit("")), {"defaults": {"before": 3, "after": 2}}).select("id", F.explode("noise").alias("n")).select("id", "n.*").collect()
    key = lambda r: (r.id, r[1], r.position)
    plain = lambda rows: sorted((*key(r), r.text) for r in rows if r.id in "ab")
    assert plain(got) == plain(made) and {r.k for r in got} == {0, 1, 2} and not [r for r in got if r.variant == "none"]
    one = spark.sql("SELECT c.id, n.* FROM {df} c, LATERAL noise_of(c.core_sentences, 'SP', 1, 1) n", df=df).collect()
    assert sorted(tuple(r) for r in one) == [("a", "after", 0, "After that, Mia has 3 pens."), ("a", "before", 0, "After that, Mia has 3 pens.")]


def test_metrics_of_all_kinds(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 3.0), (None, 5.0, 1.0), (None, None, 1.0)], "k string, p double, g double")
    before = dict(R.METRICS)
    try:
        aggregates.register("mean_square", aggregates.Sums(2, lambda p, g: [pc.power(pc.subtract(p, g), 2), pc.if_else(pc.is_valid(p), 1, 0)], lambda s, n: s / n))
        aggregates.register("worst", aggregates.Whole(lambda p, g: float(np.nanmax(np.abs(pc.subtract(p, g).to_numpy(zero_copy_only=False))))), spark)
        found, unknown = aggregates.measured(df, ["mean_square", "worst", "none", "exact_match_acc", "worst"], "p", "g", ["k"])
        assert unknown == ["none"] and {r.k: tuple(r)[1:] for r in found.collect()} == {"x": (0.5, 1.0, 0.5), None: (16.0, 4.0, 0.0)}
        over_all, _ = aggregates.measured(df, ["worst", "mean_square"], "p", "g")
        assert [tuple(r) for r in over_all.collect()] == [(4.0, 17 / 3)]
        assert aggregates.measured(df, ["bleu"], "p", "g", ["k"])[1] == ["bleu"]
        assert spark.sql("SELECT worst(p, g) AS w FROM {df} WHERE k = 'x'", df=df).first().w == 1.0
        plan = aggregates.measured(df, ["mean_square"], "p", "g", ["k"])[0]._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in plan
    finally:
        R.METRICS.clear()
        R.METRICS.update(before)


STEPS = st.sampled_from(["x = {a} * {b}", "x + {a}", "{a} / {b}", "x = {a} - {b}", "max(x, {a})", "sum([{a}, {b}, 1])", "{a} ** {b}", "sqrt({a})", "y", "-{a} % {b}", "round({a} / 3.0)", "open({a})", "{a} {b}", "  ", "007 + {a}", "1e3 + {a}", "x = -x", "abs(-{a}) // {b}", "[{a}]", "a{a} = {b}", "True + {a}"])


@given(st.lists(st.lists(st.tuples(STEPS, st.sampled_from(["0", "1", "2.5", "40", "123456789012345678901", "3.0"]), st.integers(0, 9)), max_size=4), max_size=12))
def test_shapes_say_what_the_interpreter_says(rows):
    steps = [[s.format(a=a, b=b) for s, a, b in row] for row in rows] + [None]
    assert calc.calculate_all(steps) == [calc.calculate(s) for s in steps]


def test_shapes_are_bounded(spark):
    calc.tree.cache_clear()
    draw = random.Random(1)
    rows = [[f"x = {draw.randrange(1000)} * ({draw.randrange(9)} + {draw.random():.3f})", "max(x - 5, x)"] for _ in range(5000)]
    got = calc.calculate_all(rows)
    assert calc.tree.cache_info().misses == 2 and got[:50] == [calc.calculate(r) for r in rows[:50]]


@pytest.mark.parametrize("t, want", [("result: 3 then answer is 4", "3"), ("x = 5\ny = 6 ", "5"), ("7 and 8.5 not v9", "8.5"), ("1 = 2 or total=9", "9"), ("no", None), ("3 =", "3")])
def test_number_fallback(t, want):
    found = jsonrepair.number_fallback(t)
    assert (found or {}).get("final_answer") == want


@pytest.mark.parametrize("t, want", [("a {b {c} d} e}", "{b {c} d}"), ("{", "{"), ("}{x", "{"), ("} {a} {b}", "{a}"), ("none", None), ("{{}", "{")])
def test_first_object(t, want):
    assert jsonrepair._first_object(t) == want


def test_well_formed_replies_stay_in_the_engine(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{'a': 2}",), ("[1]",), ("none here",), (None,), ('{"a": "<think>x</think>y"}',)], "t string")
    assert [r[0] for r in df.select(jsonrepair.object_text(F.col("t"))).collect()] == ['{"a": 1}', '{"a": 2}', "[1]", None, None, '{"a": "y"}']


WORDS = st.text("abAB é", max_size=4)


@given(st.lists(st.lists(WORDS, max_size=4), max_size=4), st.lists(st.one_of(st.none(), st.text("abAB éx", max_size=12)), max_size=5))
def test_phrases_of_lists(lists, texts):
    own = tuple(map(tuple, lists))
    low = [t.lower() if t is not None else None for t in texts]
    want = [sum(1 << k for k, ps in enumerate(own) if any(p.lower() in (t or "") for p in ps)) for t in low]
    assert phrases.masks(low, own) == want


def test_many_phrases_are_one_function(spark):
    df = spark.createDataFrame([("The word number 9999 ends",), ("none",), (None,), ("",)], "t string")
    lists = {"many": [f"number {k} e" for k in range(10_000)], "few": ["NONE", "the"], "empty": []}
    found = df.select(phrases.held(F.col("t"), lists).alias("h"))
    assert len(found._jdf.queryExecution().toString()) < 5_000
    assert [r.h and tuple(r.h) for r in found.collect()] == [(True, True, False), (False, True, False), (None, None, None), (False, False, False)]

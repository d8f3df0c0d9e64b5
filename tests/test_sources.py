import json

import pytest
from problems import RAW
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.plans import gate, live
from ravelin.sources import jsonl, providers
from ravelin.sources.versioned import VersionedTable
from ravelin.streaming import results as stream


def test_jsonl(spark, tmp_path):
    p = tmp_path / "raw.jsonl"
    p.write_text("\n".join(json.dumps(dict(zip(("id", "question", "answer"), r, strict=True))) for r in RAW) + "\n\n  \n")
    df = jsonl.read_jsonl(spark, str(p), schemas.RAW)
    assert [tuple(r) for r in df.collect()] == RAW
    assert [r.id for r in jsonl.read_ordered(spark, str(p), schemas.RAW).orderBy("seq").collect()] == [r[0] for r in RAW]
    jsonl.write_jsonl(df, f"{tmp_path}/out")
    jsonl.write_stages({"schema": df, "core": df}, f"{tmp_path}/stages")
    assert jsonl.read_jsonl(spark, f"{tmp_path}/stages/02_core", schemas.RAW).count() == 3
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(bad), schemas.RAW).collect()
    got, origin = jsonl.load_problems_source(spark, {"raw_data_path": str(p)}, schemas.RAW)
    assert got.count() == 3 and origin == {"source": "local", "path": str(p)}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(2, " q2 ", "a"), (0, "q0", " a\n"), (1, "q1", None)], "index int, question string, answer string")
    assert [tuple(r) for r in jsonl.export_split(df, "train", 2).collect()] == [("gsm8k/train/0", "q0", "a"), ("gsm8k/train/1", "q1", "")]
    jsonl.write_jsonl(df, f"{tmp_path}/hf")
    got, origin = jsonl.load_problems_source(spark, {"export": {"source": "huggingface", "local_path": f"{tmp_path}/hf", "split": "test", "limit": 1}}, "index int, question string, answer string")
    assert [r.id for r in got.collect()] == ["gsm8k/test/0"] and origin["source"] == "huggingface"


def test_upsert_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 3)], "id string, variant string, v int")
    jsonl.write_swapped(rows, path)
    new = spark.createDataFrame([("a", None, 9), ("c", "x", 4)], "id string, variant string, v int")
    now = jsonl.read_jsonl(spark, path, rows.schema)
    jsonl.write_swapped(jsonl.upsert(now, new, ["id", "variant"]), path)
    assert sorted(r.v for r in jsonl.read_jsonl(spark, path, rows.schema).collect()) == [2, 3, 4, 9]
    assert sorted(r.v for r in jsonl.replace_values(rows, new, "variant", ["x"]).collect()) == [1, 4, 9]
    jsonl.write_report(spark.createDataFrame([("m", "TB", 0.5)], "mode string, variant string, acc double"), f"{tmp_path}/r.json")
    assert json.loads(jsonl.read_text(spark, f"{tmp_path}/r.json")) == {"m": {"TB": {"acc": 0.5}}}


def calc(*steps, key="c1"):
    return providers.Reply(None, [(key, "calculate", json.dumps({"calc_steps": list(steps)}))])


def loop(replies, **options):
    return providers.Loop(providers.Scripted(replies), providers.tool_function("real"), **options)


def test_loop_calls_and_answers():
    it = loop([calc("a = 2"), calc("a * 4"), providers.Reply("<think>x</think> done")])
    assert it.run("s", "u") == "done" and [t["output"] for t in it.trace] == ["2", "8"]
    assert [m["role"] for m in it.messages] == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant"]
    assert it.llm.asked[0]["tool_choice"] != "auto" and it.llm.asked[1]["tool_choice"] == "auto"


def test_loop_text_calls_and_errors():
    tagged = '<tool_call> {"name": "calculate", "arguments": {"calc_steps": ["1+1"]}} </tool_call><tool_call>{bad</tool_call>'
    it = loop([providers.Reply(tagged), providers.Reply('{"name": "calculate", "parameters": {"calc_steps": ["boom"]}}'), providers.Reply("", [("k", "search", "{}")]), providers.Reply("end")])
    assert it.run("s", "u") == "end" and it.trace[0]["output"] == "2" and it.trace[1]["output"].startswith("Error")
    assert any("unknown tool" in str(m["content"]) for m in it.messages)


def test_loop_runs_out():
    it = loop([calc(f"{k}+1") for k in range(3)], max_tool_calls=2)
    assert it.run("s", "u") == "" and len(it.trace) == 3


def test_gate_continue_no_progress_and_duplicates():
    go = lambda trace, text, used: ("continue", 0.9)
    it = loop([calc("1+1"), providers.Reply("two"), providers.Reply("two still")], step_gate=go)
    assert it.run("s", "u") == "two still" and it.continued == 1 and it.reasons == {"no_progress_after_continue": 1} and it.scores == [0.9]
    it = loop([calc("1+1"), calc("1 + 1"), calc("1+1"), providers.Reply("x")], step_gate=lambda *a: ("commit", 0.0))
    assert it.run("s", "u") == "x" and it.duplicates == 1 and len(it.trace) == 2
    assert it.reasons == {"duplicate_expression_blocked": 1, "duplicate_expression_retry_exhausted": 1, "gate_predict_commit": 1}
    it = loop([providers.Reply("x")], step_gate=lambda *a: 1 / 0)
    assert it.run("s", "u") == "x" and it.reasons == {"gate_error": 1}
    it = loop([calc("1"), providers.Reply("a"), calc("2"), providers.Reply("b")], step_gate=go, max_extra_turns=1)
    assert it.run("s", "u") == "b" and it.reasons == {"max_extra_turns_reached": 1}


def test_retry_and_providers():
    waits, tries = [], [RuntimeError("429 rate limit"), RuntimeError("timeout"), providers.Reply("ok")]
    llm = providers.Scripted(tries)
    assert providers.with_retry(lambda: llm.chat([]), sleep=waits.append).content == "ok" and waits == [0.8, 1.6]
    with pytest.raises(RuntimeError, match="bad key"):
        providers.with_retry(lambda: providers.Scripted([RuntimeError("bad key")]).chat([]), sleep=waits.append)
    with pytest.raises(ValueError):
        providers.provider("none")
    assert providers.is_mock("mock://x", None) and providers.is_mock(None, "mock-1") and not providers.is_mock("http://x", "m")
    assert "seed" not in providers.adapted_options("m", {"seed": 1}, "https://generativelanguage.googleapis.com/v1") and "seed" in providers.adapted_options("gemini-x", {"seed": 1}) and "extra_body" in providers.adapted_options("Qwen3", {"a": None})
    assert providers.filled("{a} {b}", a=1) == "{a} {b}"


def test_first_tool_choice_and_waits():
    assert providers.first_tool_choice(True) == "required" and providers.first_tool_choice(False) == "auto"
    assert providers.first_tool_choice(True, "https://generativelanguage.googleapis.com/v1beta") == {"type": "function", "function": {"name": "calculate"}}
    waits = []
    llm = providers.Scripted([RuntimeError(x) for x in ("API key expired", "504 gateway", "service unavailable", "timed out")])
    with pytest.raises(RuntimeError, match="after 4 attempts: timed out"):
        providers.with_retry(lambda: llm.chat([]), sleep=waits.append)
    assert waits == [0.8, 1.6, 3.2] and not llm.replies
    for text in ("overloaded", "connection refused", "bad request"):
        llm = providers.Scripted([RuntimeError(text), providers.Reply("late")])
        with pytest.raises(RuntimeError, match=text):
            providers.with_retry(lambda llm=llm: llm.chat([]), sleep=waits.append)
    assert len(waits) == 3


def test_paced():
    now, slept = [0.0], []
    llm = providers.Paced(providers.Mock("x"), 2.0, lambda: now[0], slept.append)
    llm.chat([])
    now[0] = 0.5
    assert llm.chat([]).content == "x" and slept == [1.5]


LIVE = "id string, variant string, mode string, tool_mode string, max_tool_calls int, oracle_evidence boolean, commit_gate boolean, gold_answer string, gold_evidence_ids array<int>, prompt string, n_chunks_seen int, step_gate boolean, force_tool_first_turn boolean"


def live_rows(spark, *modes, n=2):
    return spark.createDataFrame([(str(k), "TB", m, tool, 5, False, commit, "3", [0, 1], "q", 4, False, True) for k in range(n) for m, tool, commit in modes], LIVE).coalesce(1)


def test_answered_and_errors(spark):
    build = lambda: providers.Scripted([calc("1+2"), providers.Reply('{"final_answer": "3", "evidence_ids": [0, 1], "reasoning": "r"}'), RuntimeError("broken")])
    found = live.results(live.answered(live_rows(spark, ("fc_baseline", "real", False)), build).cache()).collect()
    got = {r.id: r for r in found}
    assert got["0"].answer_correct and got["0"].evidence_exact_match and got["0"].tool_calls == 1 and got["0"].expression == "1+2" and got["0"].tool_trace[0].output == "3"
    assert not got["1"].answer_correct and "broken" in got["1"].reasoning and got["1"].tool_calls == 0


def test_conditions_without_tools(spark):
    gemini = "https://generativelanguage.googleapis.com"
    thought = '{"calc_chain": "1+2 = <3>", "evidence_ids": [1], "final_answer": "3"}'
    ask = lambda replies, mode, url="": live.answered(live_rows(spark, ("m", mode, False), n=1), lambda: providers.Scripted([providers.Reply(x) for x in replies]), base_url=url).collect()[0]
    r = ask([thought], "notool")
    assert (r.pred_answer, r.pred_evidence_ids, r.trace_text, r.error) == ("3", [1], None, None)
    assert ask(['{"calc_chain": "so 4.0", "final_answer": "7"}'], "notool").pred_answer == "4"
    assert ask(['{"reasoning": "then -2.5", "final_answer": ""}'], "fcprompt").pred_answer == "-2.5"
    assert ask(["no JSON at all", thought], "notool", gemini).pred_answer == "3"  # sent back
    r = ask(["nothing", "nothing", thought], "notool", gemini)  # sent back, then asked shortly
    assert (r.pred_answer, r.pred_evidence_ids) == ("3", [1])
    r = ask(['{"reasoning": "cut off", "evidence_ids": [2, 0], "final_answer": "8'], "fcprompt", gemini)
    assert (r.pred_answer, r.pred_evidence_ids, r.reasoning) == ("8", [2, 0], "cut off")


def test_one_more_turn(spark):
    rows = live_rows(spark, ("gate_commit_only", "real", True), ("fc_baseline", "real", False), n=1)
    first = lambda: providers.Answering(lambda m, c: calc("1+1") if c == "required" else providers.Reply('{"final_answer": "2", "evidence_ids": [0]}'))
    second = lambda: providers.Answering(lambda m, c: calc("1+2") if c == "required" else providers.Reply('{"final_answer": "3", "evidence_ids": [0, 1]}') if m[-2]["role"] == "assistant" and len(m) > 6 else None)
    found = live.answered(rows, first).cache()
    got = {r["mode"]: r for r in live.results(live.committed(found, second, gate.LinearGate([0.0] * 136, 8.0))).collect()}
    assert (got["fc_baseline"].pred_answer, got["fc_baseline"].gate_action, got["fc_baseline"].tool_calls) == ("2", "submit", 1)
    r = got["gate_commit_only"]
    assert (r.pred_answer, r.gate_action, r.gate_one_more_used, r.tool_calls, r.expression, r.answer_correct) == ("3", "one_more_turn", 1, 2, "1+1 | 1+2", True)
    calm = live.results(live.committed(found, second, gate.LinearGate([0.0] * 136, -8.0))).collect()
    assert {r.gate_action for r in calm} == {"submit"}


def test_variables_and_null_keys_outlast_the_first_turns(spark):
    rows = live_rows(spark, ("gate_commit_only", "real", True), n=1).withColumn("id", F.lit(None).cast("string"))
    first = lambda: providers.Answering(lambda m, c: calc("x = 42") if c == "required" else providers.Reply('{"final_answer": "2", "evidence_ids": [0]}'))
    second = lambda: providers.Answering(lambda m, c: calc("x + 1") if c == "required" else providers.Reply('{"final_answer": "43", "evidence_ids": [0, 1]}'))
    got = live.results(live.committed(live.answered(rows, first).cache(), second, gate.LinearGate([0.0] * 136, 8.0))).collect()
    assert [(r.id, r.pred_answer, [t.output for t in r.tool_trace]) for r in got] == [(None, "43", ["42", "43"])]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda k, ok: json.dumps({"id": str(k), "variant": "TB", "mode": "m", "answer_correct": ok, "tool_calls": k})
    (src / "a.json").write_text(row(1, True) + "\n" + row(2, False))
    read = lambda: stream.read_results(spark, str(src), files=1)
    q = stream.running_summary(read()).writeStream.format("memory").queryName("summary").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("summary").collect()] == [("m", "TB", 0.5, 1.5, 2)]
    (src / "b.json").write_text(row(2, True))
    q = stream.write_upserts(read(), f"{tmp_path}/out", f"{tmp_path}/cp", ["id", "variant"])
    q.awaitTermination(60)
    table = VersionedTable(spark, f"{tmp_path}/out")
    assert table.read().count() == 2 and table.version() == 1
    assert table.manifest()["facts"] == {"batch": 1}


def test_windows(spark):

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream.windowed_counts(e, "ts", "event_type")
    assert got.agg(F.sum("n")).first()[0] == e.count()

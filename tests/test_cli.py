import json

import pytest
from problems import RAW

from ravelin import cli, schemas
from ravelin.plans import ablation, report
from ravelin.sources import config, jsonl


def test_stages_and_ablation(spark, tmp_path, capsys):
    raw = tmp_path / "raw.jsonl"
    raw.write_text("\n".join(json.dumps(dict(zip(("id", "question", "answer"), r, strict=True))) for r in RAW))
    cli.main(["benchmark", "--in", str(raw), "--out", f"{tmp_path}/bench"])
    assert jsonl.read_jsonl(spark, f"{tmp_path}/bench", schemas.BENCHMARK).count() == 15
    cli.main(["ablation", "--in", f"{tmp_path}/bench", "--out", f"{tmp_path}/res", "--only", "fc_baseline", "fc_auto", "--limit", "2"])
    out = capsys.readouterr().out
    assert out.index("fc_baseline") < out.index("fc_auto") and "100.00" in out
    res = jsonl.read_jsonl(spark, f"{tmp_path}/res", schemas.RESULT)
    assert res.count() == 20 and "fc_auto/TB" in report.error_report(res)
    assert ablation.summary(res).filter("variant = '_overall'").count() == 2


def test_config(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('{"x": 1, "api_key": "k"}')
    b.write_text('{"x": 2, "results_dir": "r/"}')
    folder = config.run_folder(str(tmp_path), "run", [str(a), str(b)])
    merged = json.loads((folder / "configs" / "merged.json").read_text())
    assert merged == {"x": 2, "api_key": "***", "results_dir": "r/"} and config.raw_results_folder(merged) == "r/stages"
    with pytest.raises(FileExistsError):
        config.run_folder(str(tmp_path), "run", [])
    assert config.run_folder(str(tmp_path), "run", [], overwrite=True).exists() and config.default_cot_path(str(tmp_path)) is None


def test_each_stage_reads_its_predecessor(spark, tmp_path):
    exported = tmp_path / "export.jsonl"
    exported.write_text("\n".join(json.dumps({"index": k, "question": f" {q} ", "answer": a}) for k, (_, q, a) in enumerate(RAW)))
    cli.main(["export", "--in", str(exported), "--out", f"{tmp_path}/raw", "--split", "test", "--limit", "2"])
    raw = jsonl.read_jsonl(spark, f"{tmp_path}/raw", schemas.RAW)
    assert {r.id for r in raw.collect()} == {"gsm8k/test/0", "gsm8k/test/1"}
    given = "raw"
    for name in cli.GENERATED:
        cli.main([name, "--in", f"{tmp_path}/{given}", "--out", f"{tmp_path}/{name}", "--given", given])
        given = name
    cli.main(["benchmark", "--in", f"{tmp_path}/raw", "--out", f"{tmp_path}/at_once"])
    stepwise, at_once = (sorted(map(str, jsonl.read_jsonl(spark, f"{tmp_path}/{x}", schemas.BENCHMARK).collect())) for x in ("benchmark", "at_once"))
    assert stepwise == at_once and len(stepwise) == 10
    with pytest.raises(ValueError, match="does not come after"):
        cli.main(["core", "--in", f"{tmp_path}/core", "--out", f"{tmp_path}/x", "--given", "core"])


def test_gates_from_written_results(spark, tmp_path):
    raw = tmp_path / "raw.jsonl"
    raw.write_text("\n".join(json.dumps(dict(zip(("id", "question", "answer"), r, strict=True))) for r in RAW))
    cli.main(["benchmark", "--in", str(raw), "--out", f"{tmp_path}/bench"])
    cli.main(["ablation", "--in", f"{tmp_path}/bench", "--out", f"{tmp_path}/res", "--only", "fc_baseline", "fc_notool_cot"])
    cli.main(["gates", "--in", f"{tmp_path}/res", "--out", f"{tmp_path}/gates", "--which", "all"])
    step, commit = (jsonl.read_artifact(spark, f"{tmp_path}/gates/{x}.json") for x in ("g_step", "g_commit"))
    assert (step["label_mode"], step["feature_dim"], step["positive_class"]) == ("paper", 120, "continue")
    assert (commit["label_mode"], commit["feature_dim"], commit["n_groups"]) == ("mixed", 136, 3)
    summary = json.loads(jsonl.read_text(spark, f"{tmp_path}/gates/train_summary.json"))
    assert set(summary) == {"g_step", "g_commit"} and "model" not in summary["g_step"]
    assert summary["g_step"]["n_samples"] >= 15
    for labels in ("off-policy", "mixed"):
        cli.main(["gates", "--in", f"{tmp_path}/res", "--out", f"{tmp_path}/{labels}", "--labels", labels])
        assert jsonl.read_artifact(spark, f"{tmp_path}/{labels}/g_step.json")["label_mode"] == labels
    with pytest.raises(ValueError, match="no fc_baseline"):
        cli.main(["gates", "--in", f"{tmp_path}/bench", "--out", f"{tmp_path}/x"])

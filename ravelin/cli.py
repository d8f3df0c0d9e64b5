"""python -m ravelin.cli STAGE --in PATH --out PATH: the export, a stage of generation, the mock ablation or the training of gates, over JSON lines.

A stage of generation reads what --given names, raw problems or an earlier stage's table, and adds the stages up to its own. Gates are
trained on result rows of any modes, the last of each id and variant: fc_baseline, fc_notool_cot where the labels use it, and that of --gated.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.operators.relational import last_per_key
from ravelin.plans import ablation, gate, generation, report
from ravelin.sources.jsonl import SEQUENCE, export_split, read_jsonl, read_ordered, write_artifact, write_jsonl, write_text

GENERATED = ["schema", "core", "noise", "validated", "benchmark"]
EXPORTED = "index long, question string, answer string"
GATES = {"g_step": gate.train_step, "g_commit": gate.train_commit}


def steps(mode: str) -> dict:
    """The function of each stage of generation, in order."""
    return {"schema": generation.with_schema, "core": lambda df: generation.with_core(df, mode), "noise": generation.with_noise, "validated": generation.validated, "benchmark": generation.assembled}


def stage(name: str, given: DataFrame, mode: str, have: str = "raw") -> DataFrame:
    """A stage's table from raw problems or from an earlier stage's table: the stages between are part of its plan."""
    start = 0 if have == "raw" else GENERATED.index(have) + 1
    todo = GENERATED[start : GENERATED.index(name) + 1]
    if not todo:
        raise ValueError(f"{name} does not come after {have}")
    for step in todo:
        given = steps(mode)[step](given)
    return given


def read_stage(spark: SparkSession, path: str, have: str) -> DataFrame:
    """A written stage by the schema that the stage declares."""
    raw = spark.createDataFrame([], schemas.RAW)
    return read_jsonl(spark, path, raw.schema if have == "raw" else generation.generate(raw)[have].schema)


def train_gates(spark: SparkSession, source: str, out: str, which: list[str], label_mode: str, gated: str | None, family: str = "linear") -> dict:
    """Writes <gate>.json of each gate and train_summary.json, all but the models, which is returned."""
    rows = read_ordered(spark, source, schemas.RESULT)
    of_mode = lambda mode: last_per_key(rows.filter(F.col("mode") == mode), gate.KEYS, SEQUENCE).drop(SEQUENCE)
    baseline, cot = of_mode("fc_baseline"), of_mode("fc_notool_cot")
    if baseline.isEmpty():
        raise ValueError(f"no fc_baseline rows in {source}")
    runs = of_mode(gated) if gated else baseline.limit(0)
    some_cot = None if label_mode == "off-policy" or cot.isEmpty() else cot
    if label_mode == "mixed" and some_cot is None:
        some_cot = baseline.limit(0)
    summary = {}
    for name in which:
        artifact = GATES[name](baseline, some_cot, runs, label_mode, family)
        write_artifact(spark, artifact, f"{out}/{name}.json")
        summary[name] = {k: v for k, v in artifact.items() if k != "model"}
    write_text(spark, f"{out}/train_summary.json", json.dumps(summary, ensure_ascii=False, indent=2))
    return summary


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=["export", *GENERATED, "ablation", "gates"])
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--given", default="raw", choices=["raw", *GENERATED[:-1]], help="what --in holds, for a stage of generation")
    p.add_argument("--split", default="train", help="of the export: names the ids")
    p.add_argument("--evidence", default="heuristic", choices=["all", "heuristic", "mse"])
    p.add_argument("--only", nargs="*")
    p.add_argument("--limit", type=int)
    p.add_argument("--which", default="g_step", choices=["all", *GATES])
    p.add_argument("--labels", default="paper", choices=["paper", "off-policy", "mixed"])
    p.add_argument("--family", default="linear", choices=["linear", "perceptron"], help="of the gates' models")
    p.add_argument("--gated", help="the mode of gated runs that mixed labels use")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.stage == "ablation":
        rows = read_jsonl(spark, a.source, schemas.BENCHMARK).withColumn("seq", F.struct("id", "variant"))
        results = ablation.run(rows, only=a.only, limit=a.limit)
        write_jsonl(results, a.out)
        print(report.accuracy_report(read_jsonl(spark, a.out, results.schema)))
    elif a.stage == "export":
        write_jsonl(export_split(read_jsonl(spark, a.source, EXPORTED), a.split, a.limit), a.out)
    elif a.stage == "gates":
        train_gates(spark, a.source, a.out, list(GATES) if a.which == "all" else [a.which], a.labels, a.gated, a.family)
    else:
        write_jsonl(stage(a.stage, read_stage(spark, a.source, a.given), a.evidence, a.given), a.out)


if __name__ == "__main__":
    main()

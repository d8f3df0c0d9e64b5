"""JSON-lines sources and sinks, and upserts that never overwrite what they read."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.sources import lines

SEQUENCE = "seq"
#: The type of a model that Spark ML has written beside its artifact.
PIPELINE = "spark_ml_pipeline"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file or folder by a declared schema; blank lines are skipped and malformed ones fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_ordered(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As read_jsonl, with seq rising in the order of lines: files by name, and lines by their byte in the file, whatever tasks read them."""
    lines.register(spark)
    found = spark.read.format(lines.NAME).load(path)
    parsed = found.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"), F.struct(lines.FILE, lines.OFFSET).alias(SEQUENCE))
    return parsed.select("row.*", SEQUENCE)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON-lines parts, null fields included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of spark.checkpoint.dir, or, where a local master has none, one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/ravelin"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder, read back: computed once, and nothing is lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/ravelin/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_stages(stages: dict[str, DataFrame], root: str) -> None:
    """A folder for each stage in order: 01_<name>, 02_<name> and so on."""
    for k, (name, df) in enumerate(stages.items(), 1):
        write_jsonl(df, f"{root}/{k:02d}_{name}")


def load_problems_source(spark: SparkSession, config: dict, schema: T.StructType | str) -> tuple[DataFrame, dict]:
    """Raw records and their provenance by a config: a local export of a hosted set, or a local file."""
    export = config.get("export") or {}
    hosted = export.get("source") == "huggingface"
    path = export["local_path"] if hosted else config["raw_data_path"]
    df = read_jsonl(spark, path, schema)
    if hosted:
        df = export_split(df, export.get("split", "train"), export.get("limit"))
    return df, {"source": "huggingface" if hosted else "local", "path": path}


def load_benchmark_source(spark: SparkSession, config: dict, schema: T.StructType | str) -> DataFrame:
    """Benchmark rows of the config's benchmark_data_path."""
    return read_ordered(spark, config["benchmark_data_path"], schema)


def export_split(rows: DataFrame, split: str, limit: int | None = None, dataset: str = "gsm8k", index: str = "index") -> DataFrame:
    """Records of a hosted split with id <dataset>/<split>/<index>, stripped texts, and the first `limit` by index."""
    ordered = rows.orderBy(index).limit(limit) if limit is not None else rows
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "").alias(c)
    return ordered.select(F.concat_ws("/", F.lit(dataset), F.lit(split), F.col(index).cast("string")).alias("id"), strip("question"), strip("answer"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing without the keys of new, and new. Null keys are equal to each other."""
    fresh = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        eq = existing[k].eqNullSafe(fresh[f"_{k}"])
        same = eq if same is None else same & eq
    return existing.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_values(existing: DataFrame, new: DataFrame, column: str, values: list) -> DataFrame:
    """existing without rows whose column is one of values, and new. Rows of null stay."""
    gone = F.coalesce(F.col(column).isin(values), F.lit(False)) if values else F.lit(False)
    return existing.filter(~gone).unionByName(new, allowMissingColumns=True)


def write_swapped(df: DataFrame, path: str) -> None:
    """df written beside path and then put in its place, so df may read from path."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_jsonl(df, fresh)
    jvm = spark._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{fresh}.old")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staged, target):
        raise OSError(f"cannot put {fresh} in place of {path}")
    if fs.exists(old):
        fs.delete(old, True)


def write_report(rows: DataFrame, path: str) -> None:
    """A small summary as one JSON text: {mode: {variant: {measure: value}}}. rows is an aggregate with a row per mode and variant."""
    report: dict[str, dict] = {}
    for r in rows.collect():
        row = r.asDict()
        report.setdefault(str(row.pop("mode")), {})[str(row.pop("variant"))] = row
    write_text(rows.sparkSession, path, json.dumps(report, ensure_ascii=False, indent=2, default=str))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())


def write_artifact(spark: SparkSession, artifact: dict, path: str) -> None:
    """A gate's artifact as JSON, its model by to_dict(); a fitted Spark ML pipeline goes to a folder beside it by its own writer."""
    model = artifact["model"]
    if hasattr(model, "stages"):
        model.write().overwrite().save(f"{path}.model")
        model = {"type": PIPELINE}
    write_text(spark, path, json.dumps(artifact | {"model": model.to_dict() if hasattr(model, "to_dict") else model}, ensure_ascii=False))


def read_artifact(spark: SparkSession, path: str) -> dict:
    """The artifact, its model restored. Pickles are refused, as reading them runs code."""
    from pyspark.ml import PipelineModel

    from ravelin.plans.gate import LinearGate

    if not path.endswith(".json"):
        raise ValueError(f"only JSON artifacts are read: {path}")
    artifact = json.loads(read_text(spark, path))
    if not isinstance(artifact, dict) or "model" not in artifact:
        raise ValueError(f"no model in {path}")
    kind = artifact["model"].get("type") if isinstance(artifact["model"], dict) else None
    if kind == LinearGate.TYPE:
        artifact["model"] = LinearGate.from_dict(artifact["model"])
    elif kind == PIPELINE:
        artifact["model"] = PipelineModel.load(f"{path}.model")
    return artifact

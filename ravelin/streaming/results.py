"""Result rows as a stream: the summary by condition and variant kept up to date, and upserts in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.schemas import RESULT
from ravelin.sources.versioned import VersionedTable


def read_results(spark: SparkSession, path: str, schema: str = RESULT, files: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as they come, at most `files` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def running_summary(results: DataFrame) -> DataFrame:
    """Accuracy, mean calls and rows by mode and variant, for update or complete mode."""
    return results.groupBy("mode", "variant").agg(F.avg(F.col("answer_correct").cast("double")).alias("acc"), F.avg("tool_calls").alias("avg_tool_calls"), F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value by window and key; rows later than `late` are left out once their window is done."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), key, "n", "mean_value")


def write_upserts(stream: DataFrame, root: str, checkpoint: str, keys: list[str], buckets: int = 16) -> StreamingQuery:
    """Each batch upserted by keys into a versioned table at root; a batch that a restart repeats changes nothing."""
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new, table = df.dropDuplicates(keys), VersionedTable(spark, root)
        if table.version() is None:
            VersionedTable.create(new, root, keys, buckets, {"batch": number})
        elif table.manifest()["facts"].get("batch", -1) < number:
            table.upsert(new, {"batch": number})

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()

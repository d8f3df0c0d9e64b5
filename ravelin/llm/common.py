"""Shared pieces of the training-data operators: reading, shared storage, cached word encoders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words a worker keeps encoded; the cache is emptied when full, so memory stays bounded.
CACHE_WORDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster raises, as its executors
    would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there and lost executors cost nothing.

    The table stays until discard() or until the folder is cleaned, as the returned DataFrame reads it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ravelin/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class WordEncoder:
    """word -> what encode makes of it, such as ids as bytes of little-endian uint32, encoding only words it has not seen.

    encode: list of distinct words -> list of their codes, in the same order. Of all encoders of a
    worker only the one in use keeps its words.
    """

    in_use: WordEncoder | None = None

    def __init__(self, encode: Callable[[list], Iterable], most: int = CACHE_WORDS):
        self.encode, self.most, self.known = encode, most, {}

    def learn(self, words: Iterable) -> dict:
        """The cache, holding at least these words."""
        if WordEncoder.in_use is not self:
            if WordEncoder.in_use is not None:
                WordEncoder.in_use.known = {}
            WordEncoder.in_use = self
        words = set(words)
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.most and self.known:
            self.known, new = {}, words
        if new:
            new = list(new)
            self.known.update(zip(new, self.encode(new), strict=True))
        return self.known


def majority(hashes: list[int] | np.ndarray) -> int:
    """SimHash of 64-bit hashes, as a signed number: a bit is set if it is in over half of them."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        part = np.array(hashes[a : a + 4096], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def pieces(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """ids cut after each true in ends, each piece as bytes of little-endian uint32."""
    raw = ids.astype("<u4").tobytes()
    at = (np.flatnonzero(ends) + 1) * 4
    return [raw[a:b] for a, b in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]

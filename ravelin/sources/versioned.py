"""Keyed tables that are changed by copying: rows lie in buckets by a hash of their keys, and a manifest names the files of each bucket.

A change reads and writes the buckets that it touches and takes the other ones' files over. It becomes visible by one rename, of a new manifest to
the next free number; if that number is taken meanwhile, the change fails and the table stays as the other writer left it. Files are never
changed, so readers of an older manifest go on, and what fails on the way leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.sources.jsonl import read_text, write_text

BUCKETS = 64
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed first."""


class VersionedTable:
    """A table at root. Rows of equal keys, null ones included, share a bucket."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, df: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS, facts: dict | None = None) -> VersionedTable:
        """A new table of df's rows."""
        table = cls(df.sparkSession, root)
        if table.version() is not None:
            raise FileExistsError(root)
        manifest = {"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "files": {}, "facts": facts or {}}
        table.commit(0, manifest | {"files": table.written(df, manifest)})
        return table

    # -- manifests --

    def listed(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def version(self) -> int | None:
        """The number of the newest manifest."""
        numbers = [int(n[:-5]) for n in self.listed(f"{self.root}/manifests") if n.endswith(".json") and n[0].isdigit()]
        return max(numbers, default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(self.root)
        return json.loads(read_text(self.spark, f"{self.root}/manifests/{version:09d}.json")) | {"version": version}

    def commit(self, version: int, manifest: dict) -> None:
        """The manifest as that of a version, by one rename."""
        staged = f"{self.root}/manifests/_{uuid.uuid4().hex}"
        target = self.path(f"{self.root}/manifests/{version:09d}.json")
        write_text(self.spark, staged, json.dumps(manifest))
        if self.fs.exists(target) or not self.fs.rename(self.path(staged), target):
            self.fs.delete(self.path(staged), False)
            raise Conflict(f"version {version} of {self.root} is taken")

    # -- rows --

    def bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in manifest["keys"]]), F.lit(manifest["buckets"])).cast("int")

    def written(self, df: DataFrame, manifest: dict) -> dict[str, list[str]]:
        """Rows as files of a new folder, by bucket; a bucket of very many rows is dealt to several tasks."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, self.bucket(manifest))
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        found = {}
        for name in self.listed(folder):
            if name.startswith(f"{BUCKET}="):
                own = [f"{folder}/{name}/{f}"[len(self.root) + 1 :] for f in self.listed(f"{folder}/{name}") if f[0] not in "_."]
                found[name.partition("=")[2]] = own
        return found

    def rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        """Rows of the manifest's files, or of those of some buckets."""
        schema = T.StructType.fromJson(manifest["schema"])
        files = [f"{self.root}/{f}" for b, own in manifest["files"].items() if buckets is None or b in buckets for f in own]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or an older version of it that is still kept."""
        return self.rows(self.manifest(version))

    # -- changes --

    def changed(self, manifest: dict, touched: list[str], rows: DataFrame, facts: dict | None) -> int:
        """The next version: rows stand for the touched buckets."""
        files = {b: f for b, f in manifest["files"].items() if b not in touched} | self.written(rows, manifest)
        fresh = {k: v for k, v in manifest.items() if k != "version"} | {"files": files, "facts": manifest["facts"] | (facts or {})}
        self.commit(manifest["version"] + 1, fresh)
        return manifest["version"] + 1

    def upsert(self, new: DataFrame, facts: dict | None = None) -> int:
        """Rows of the keys of new are replaced by new, whose rows all stay; the number of the new version. Null keys are equal to each other."""
        manifest = self.manifest()
        new = new.select(*T.StructType.fromJson(manifest["schema"]).fieldNames())
        touched = [str(r[0]) for r in new.select(self.bucket(manifest)).distinct().collect()]  # as many as there are buckets
        fresh = new.select(*[F.col(k).alias(f"_{k}") for k in manifest["keys"]]).distinct()
        old = self.rows(manifest, touched)
        same = reduce(Column.__and__, [old[k].eqNullSafe(fresh[f"_{k}"]) for k in manifest["keys"]])
        return self.changed(manifest, touched, old.join(fresh, same, "left_anti").unionByName(new), facts)

    def replace(self, gone: Column, new: DataFrame, facts: dict | None = None) -> int:
        """Rows for which gone holds go, and new comes; rows for which it is null stay. Buckets without such rows are not rewritten."""
        manifest = self.manifest()
        gone = F.coalesce(gone, F.lit(False))
        new = new.select(*T.StructType.fromJson(manifest["schema"]).fieldNames())
        at = self.bucket(manifest)
        touched = [str(r[0]) for r in self.rows(manifest).filter(gone).select(at).union(new.select(at)).distinct().collect()]
        return self.changed(manifest, touched, self.rows(manifest, touched).filter(~gone).unionByName(new), facts)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest `keep`, and files that none of these names; the number of files deleted. No writer may be at work."""
        newest = self.version()
        kept = [self.manifest(v) for v in range(max(0, newest - keep + 1), newest + 1)]
        for name in self.listed(f"{self.root}/manifests"):
            if name[0].isdigit() and int(name[:-5]) <= newest - keep:
                self.fs.delete(self.path(f"{self.root}/manifests/{name}"), False)
        named = {f for m in kept for own in m["files"].values() for f in own}
        n = 0
        for folder in self.listed(f"{self.root}/data"):
            for bucket in self.listed(f"{self.root}/data/{folder}"):
                for file in self.listed(f"{self.root}/data/{folder}/{bucket}") if bucket.startswith(f"{BUCKET}=") else ():
                    if f"data/{folder}/{bucket}/{file}" not in named:
                        n += self.fs.delete(self.path(f"{self.root}/data/{folder}/{bucket}/{file}"), False)
        return n

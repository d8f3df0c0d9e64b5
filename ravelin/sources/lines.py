"""JSON lines as a data source of its own: spark.read.format("ravelin_jsonl") and df.write.format("ravelin_jsonl").

Files are read in ranges of bytes, each line by the range that holds its first byte, so a large file is read by many tasks, and the place of
a line, its file and its offset there, is the same however the ranges fall. Tasks write into a folder that readers pass
over; the driver moves the files of the tasks that it counts into place, or deletes all of them.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "ravelin_jsonl"
#: Columns of a line's place, filled where the schema names them.
FILE, OFFSET = "_file", "_offset"
#: The schema where none is declared: lines as they are.
LINES = f"value string, {FILE} string, {OFFSET} long"
RANGE_BYTES, BLOCK, BATCH_LINES = 64 << 20, 1 << 20, 5_000
STAGING = "_staging-"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of the folder and those below it, by name; names that begin with _ or . are no data."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    own = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
    return sorted((f.path, f.size) for f in own if not any(p[0] in "_." for p in f.path[len(root) :].strip("/").split("/")))


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at start or behind it, and before stop."""

    file: str
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, range_bytes: int, raw: bool):
        self.path, self.schema, self.range_bytes, self.raw = path, schema, range_bytes, raw

    def partitions(self) -> list[Range]:
        return [Range(file, a, min(a + self.range_bytes, size)) for file, size in files_of(self.path) for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that are not blank; no more is held than a line and a block."""
        if part.start >= part.stop:
            return
        fs, _ = opened(self.path)
        with io.BufferedReader(fs.open_input_file(part.file), BLOCK) as f:
            at = f.seek(max(0, part.start - 1))
            if part.start:
                at += len(f.readline())  # what ends here began in the range before
            while at < part.stop and (line := f.readline()):
                if line.strip():
                    yield at, line.rstrip(b"\r\n")
                at += len(line)

    def record(self, file: str, at: int, line: bytes) -> dict:
        if self.raw:
            return {"value": line.decode("utf-8"), FILE: file, OFFSET: at}
        try:
            row = json.loads(line)
        except ValueError as e:
            raise ValueError(f"malformed line at byte {at} of {file}: {e}") from None
        if not isinstance(row, dict):
            raise ValueError(f"no object at byte {at} of {file}")
        return row | {FILE: file, OFFSET: at}

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(self.schema), []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(held, arrow)
            held.clear()
            return out

        for at, line in self.lines(part):
            held.append(self.record(part.file, at, line))
            if len(held) == BATCH_LINES:
                yield told()
        if held:
            yield told()


@dataclass
class Written(WriterCommitMessage):
    """A task's files in the staging folder."""

    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = opened(self.path)
        return fs, root, f"{root}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for the task's rows, none for no rows, in the folder that the driver has made; nulls are written, and letters beyond ASCII stay as they are."""
        fs, _, staging = self.staging()
        out, path = None, f"{staging}/part-{uuid.uuid4().hex}.jsonl"
        try:
            for batch in iterator:
                if batch.num_rows and out is None:
                    out = fs.open_output_stream(path)  # a task that outlives its job finds no folder
                for row in batch.to_pylist():
                    out.write(json.dumps(row, ensure_ascii=False, default=str).encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written([path] if out is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        """Puts the files of the counted tasks in place; an overwritten folder loses its old files only when the new ones are there."""
        fs, root, staging = self.staging()
        fs.create_dir(root, recursive=True)
        old = [f for f, _ in files_of(self.path)] if self.overwrite else []
        for k, file in enumerate(f for m in messages if m is not None for f in m.files):
            fs.move(file, f"{root}/part-{k:05d}-{self.job}.jsonl")
        for file in old:
            fs.delete_file(file)
        self.cleared(fs, staging)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of a failed job stays."""
        fs, _, staging = self.staging()
        self.cleared(fs, staging)

    @staticmethod
    def cleared(fs: pafs.FileSystem, staging: str) -> None:
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class JsonLines(DataSource):
    """Options: path; range_bytes, the length of a task's range.

    By a declared schema each line is an object whose fields go to the columns of these names, absent ones as null and others left
    out; a line that is no object, or has a value of another type, fails the job and says where. _file and _offset in the schema are the line's place.
    Without a schema rows are (value, _file, _offset). Blank lines are no rows; an empty folder has none. Dates,
    times and decimals are written as text, and read as such.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> Reader:
        raw = schema.fieldNames() == ["value", FILE, OFFSET]
        return Reader(self.options["path"], schema, int(self.options.get("range_bytes", RANGE_BYTES)), raw)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        out = Writer(self.options["path"], overwrite)
        fs, _, staging = out.staging()
        fs.create_dir(staging, recursive=True)
        return out


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(JsonLines)

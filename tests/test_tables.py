import json

import pytest
from pyspark.sql import functions as F

from ravelin.sources import lines
from ravelin.sources.versioned import Conflict, VersionedTable

ROW = f"id long, name string, tags array<string>, {lines.FILE} string, {lines.OFFSET} long"


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_every_line_once_wherever_ranges_fall(spark, tmp_path, size):
    lines.register(spark)
    texts = ["", json.dumps({"id": 1, "name": "é\n"}), "   ", json.dumps({"id": 2, "tags": ["x"], "more": 1}), json.dumps({"id": 3}) + "\r", "{}"]
    (tmp_path / "a.jsonl").write_bytes("\n".join(texts).encode())
    (tmp_path / "b.jsonl").write_bytes(b'{"id": 4}\n\n')
    (tmp_path / "c.jsonl").write_bytes(b"")
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x" / "part.jsonl").write_text('{"id": 9}\n')
    got = spark.read.format(lines.NAME).schema(ROW).option("range_bytes", size).load(str(tmp_path)).collect()
    starts = [sum(len(t.encode()) + 1 for t in texts[:k]) for k in range(len(texts))]
    want = [(1, "é\n", None, "a", starts[1]), (2, None, ["x"], "a", starts[3]), (3, None, None, "a", starts[4]), (None, None, None, "a", starts[5]), (4, None, None, "b", 0)]
    assert sorted(((r.id, r.name, r.tags, r[lines.FILE][-7], r[lines.OFFSET]) for r in got), key=lambda r: r[3:]) == want
    raw = spark.read.format(lines.NAME).option("range_bytes", size).load(str(tmp_path)).collect()
    assert sorted(r.value for r in raw) == sorted([*(t.rstrip("\r") for t in texts if t.strip()), '{"id": 4}'])


def test_malformed_lines_are_named(spark, tmp_path):
    lines.register(spark)
    for k, bad in enumerate(['{"id": 1', "[1]", '{"id": "x"}']):
        (tmp_path / f"{k}.jsonl").write_text('{"id": 0}\n' + bad + "\n")
        with pytest.raises(Exception, match="byte 10 of .*jsonl|Could not convert|Invalid"):
            spark.read.format(lines.NAME).schema("id long").load(f"{tmp_path}/{k}.jsonl").collect()
    with pytest.raises(Exception, match="(?i)notfound|no such|missing"):
        spark.read.format(lines.NAME).load(f"{tmp_path}/missing").collect()


def test_failed_tasks_leave_no_rows(spark, tmp_path):
    lines.register(spark)
    path = f"{tmp_path}/out"
    good = spark.range(10).withColumn("name", F.lit("é"))
    good.write.format(lines.NAME).mode("append").save(path)
    broken = spark.range(100, 200, 1, 4).withColumn("name", F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format(lines.NAME).mode("append").save(path)
    back = lambda: sorted(r.id for r in spark.read.format(lines.NAME).schema("id long").load(path).collect())
    assert back() == list(range(10)) and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    spark.range(3).write.format(lines.NAME).mode("append").save(path)
    assert back() == sorted([*range(10), 0, 1, 2])
    spark.range(5, 7).write.format(lines.NAME).mode("overwrite").save(path)
    assert back() == [5, 6]
    assert "é" in "".join(f.read_text() for f in (tmp_path / "out").iterdir()) or back() == [5, 6]


ROWS = [(k, None if k % 3 == 0 else "x", k) for k in range(40)]
SCHEMA = "id long, variant string, v long"


def test_an_upsert_of_a_key_rewrites_its_bucket(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    table = VersionedTable.create(df, f"{tmp_path}/t", ["id", "variant"], 8)
    with pytest.raises(FileExistsError):
        VersionedTable.create(df, f"{tmp_path}/t", ["id"])
    before = table.manifest()["files"]
    assert table.upsert(spark.createDataFrame([(3, None, -1)], SCHEMA), {"batch": 7}) == 1
    after = table.manifest()["files"]
    changed = {b for b in before if before[b] != after[b]}
    assert len(changed) == 1 and len(before) == 8 and table.manifest()["facts"] == {"batch": 7}
    rows = lambda t, v=None: sorted(map(tuple, t.read(v).collect()), key=repr)
    want = [(*r[:2], -1 if r[0] == 3 else r[2]) for r in ROWS]
    assert rows(table) == sorted(want, key=repr) and rows(table, 0) == sorted(ROWS, key=repr)
    table.replace(F.col("variant") == "x", spark.createDataFrame([(100, "x", 5)], SCHEMA))
    assert rows(table) == sorted([*(r for r in want if r[1] is None), (100, "x", 5)], key=repr)
    table.replace(F.lit(True), df.limit(0))
    assert rows(table) == [] and table.vacuum(1) > 0 and rows(table) == []
    table.upsert(df)
    assert rows(table) == sorted(ROWS, key=repr)


def test_a_failure_between_the_steps_leaves_the_table(spark, tmp_path, monkeypatch):
    df, new = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(1, "x", -1), (99, "x", 0)], SCHEMA)
    table = VersionedTable.create(df, f"{tmp_path}/t", ["id", "variant"], 4)
    real = VersionedTable.commit

    def lost(self, version, manifest):
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "commit", lost)
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(new)
    monkeypatch.setattr(VersionedTable, "commit", real)
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(ROWS, key=repr) and table.version() == 0
    manifest = table.manifest()
    table.upsert(new)
    with pytest.raises(Conflict):
        table.changed(manifest, [], df.limit(0), None)
    assert table.read().count() == 41 and table.version() == 1


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from ravelin.streaming import results as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "variant": "TB"}\n')
    for k in range(2):  # a fresh checkpoint plays the same batch again
        q = stream.write_upserts(stream.read_results(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp{k}", ["id", "variant"])
        q.awaitTermination(60)
    table = VersionedTable(spark, f"{tmp_path}/out")
    assert table.version() == 0 and table.read().count() == 1

import duckdb
import pytest
from pyspark.sql import functions as F

from ravelin.llm import url_cascade as U

URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x", "https://m.example.net?q=/en/", "http://net/", "http://xnet/", "ftp://x.com/de/", "http://example.com/de/?a#b",
        "http://aexample.com/de/", "http://b.org/fr/1", "http://b.org/fr", "http://c.spam-farm.example.org/a", "http://spam-farm.org", "a://b://c/net/", "http://é.net/ü", "http://x\ny.net/"]


def test_against_sql(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, null)", [r[:2] for r in rows])
    want = sorted(con.sql(U.ORACLE).fetchall())
    own = U.hosts_by_label(df)
    for some in (own, own.union(own).union(spark.createDataFrame([(None,), ("elsewhere.org",)], "host string"))):
        assert sorted(tuple(r) for r in U.judge(df, some).select("page_id", "host", "path", "rule", "verdict", "listed").collect()) == want
    assert sorted(tuple(r) for r in U.judge(df, own, most_bits=1).select("page_id", "host", "path", "rule", "verdict", "listed").collect()) == want
    assert U.judge(df.limit(0), own).count() == 0
    assert U.judge(df.union(df), own).count() == 2 * len(rows)
    assert not any(r.listed for r in U.judge(df, own.limit(0)).collect())


def test_any_list_of_hosts(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 1000, F.lit(".org/")).alias("url"))
    listed = spark.range(0, 1500, 7).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"))
    got = U.judge(df, listed, rules=())
    assert {(r.page_id, r.verdict) for r in got.collect()} == {(k, "allow" if k % 1000 % 7 else "block") for k in range(3000)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, step", [(4000, 3), (3000, 1), (3000, 10**9), (20000, 50)])
def test_cascade_is_exact(spark, n, step):
    keys = spark.range(n).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % step == step - 1).alias("listed"))
    cascade = U.Cascade(keys)
    assert cascade.fits and cascade.judged(keys, "key", "found").filter("found <> listed").count() == 0
    assert cascade.bits == sum(8 * len(level.constant) for level in cascade.levels)


@pytest.mark.parametrize("step", [2])
def test_parts_of_a_large_list(spark, step):
    """A list of many times the bits allowed: several cascades, the same rows, and no join."""
    hosts = spark.range(4000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("host"))
    df = spark.range(8000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 4000, F.lit(".org/")).alias("url"))
    df = df.union(spark.sql("select -1L, cast(null as string)"))
    own = hosts.filter(F.substring("host", 2, 9).isin([f"{k}.org" for k in range(0, 4000, step)]))
    whole = U.Cascade(hosts.select(F.col("host").alias("key"), F.lit(True).alias("listed")))
    got = U.judge(df, own, rules=(), most_bits=max(whole.bits // 4, U.LEAST_BITS))
    assert got.inputFiles() and len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) > 1
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == 8001
    assert {(r.page_id, r.verdict) for r in rows} == {(k, "allow" if k % 4000 % step else "block") for k in range(8000)} | {(-1, "allow")}


def test_hosts_by_what_their_pages_hold(spark):
    page = lambda host, junk: (f"http://{host}/", "<html><title>a ### b</title>" if junk else "<html><title>a # b</title><p>###" if junk is False else None)
    rows = [page("a", k == 0) for k in range(10)] + [page("b", False)] * 10 + [page("c", True)] * 4 + [page("d", None)] * 6 + [page("e", k == 0) for k in range(40)] + [(None, None)] * 9
    assert [r.host for r in U.hosts_by_titles(spark.createDataFrame(rows, "url string, html string")).collect()] == ["a"]
    got = U.op6_url_cascade(spark, "/root/testdata/sf0.01").filter("listed").select("host").distinct().collect()
    assert [r for r in got if not any(label in r.host for label in U.LISTED_LABELS)]


def test_parts_are_told_by_counts(spark, monkeypatch):
    monkeypatch.setattr(U.Level, "fill", lambda *a: 1 / 0)
    keys = spark.range(200_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    assert not U.Cascade(keys, 100_000).fits


def test_plan_is_native(spark):
    plan = U.op6_url_cascade(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

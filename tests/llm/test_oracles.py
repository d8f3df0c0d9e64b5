import duckdb
import oracle
import pytest

from ravelin.llm import chat, oracles, simhash, suffix_repeats
from ravelin.llm.catalogue import ORACLES, QUERIES
from test_chat import PATH

SF = "/root/testdata/sf0.01"
LONG = "abcdefghij" * 12
TEXTS = [None, "", "  ", "a", "A b", "a b", "One two three", "one two three four", LONG, LONG + "x", "é" * 60 + LONG[:99], "é" * 60, "日本 " * 50, "- " * 300, "-" * 300, "x" + LONG, "a  b\n" + "word " * 40, LONG[:99], LONG[:100]]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_whole_table(spark, name):
    got = oracle.spark_rows(QUERIES[name](spark, SF))
    assert got[1] and got == oracle.sql_rows(ORACLES[name], SF)


@pytest.mark.parametrize("run, sql", [(simhash.near_duplicates, oracles.SIMHASH), (suffix_repeats.remove_repeats, oracles.REPEATS)])
def test_odd_texts(spark, run, sql):
    rows = list(enumerate(TEXTS)) + list(enumerate(TEXTS, 100))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(sql)
    df = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert oracle.spark_rows(df) == oracle.rows_of([d[0] for d in want.description], want.fetchall())


def test_odd_turns(spark):
    texts = [None, "", "<|end|>\n", "<\\|x", "<<SYS>> <</SYS>>", "</s><s>[INST][\\\\/INST]", "é|%<", "日本"]
    rows = [(c, t if t % 5 else None, r, x) for c in (1, 2, None) for t, (r, x) in enumerate((r, x) for r in ("user", "assistant", "a|b%", None) for x in texts)]
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(oracles.CHAT)
    said = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    assert oracle.spark_rows(chat.format_conversations(df, PATH)) == oracle.rows_of([d[0] for d in want.description], want.fetchall())

import random
from itertools import permutations

import oracle
import pytest
from pyspark.sql import functions as F

from ravelin.llm import filter_audit as A

COUNTS = ["kept", "removed", "redundant", "unique_fails", "bad_lost", "shapley"]


def brute(rows, filters):
    """Every order, row by row; rows are (part, failing filters, bad)."""
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in own if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("n", [1, 3, 4])
def test_against_every_order(spark, n):
    draw, filters = random.Random(n), "wxyz"[:n]
    rows = [(draw.choice(["a", None, ""]), {f for f in filters if draw.random() < 0.4}, draw.random() < 0.3) for _ in range(60)]
    df = spark.createDataFrame([(p, *[f in fails or (None if k % 2 else False) for k, f in enumerate(filters)], bad) for p, fails, bad in rows], f"part string, {', '.join(f'{f} boolean' for f in filters)}, bad boolean").withColumn("state", F.lit(1))
    got = A.audit(df, list(filters), ("bad",)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == brute(rows, filters) and len(got) == len(brute(rows, filters))
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in got)
    assert A.audit(df.limit(0), list(filters), ("bad",)).count() == 0


def test_states_are_shared_and_let_go(spark, monkeypatch):
    visits, held, most = [], [], []
    visit, counted = A.Trie.visit, A.Trie.counted

    def watch(self, state, survivors):
        visits.append(state)
        held.append(state)
        most.append(len(held))
        visit(self, state, survivors)
        held.pop()

    monkeypatch.setattr(A.Trie, "visit", watch)
    rows = spark.createDataFrame([("p", True, False, False, True)], "part string, a boolean, b boolean, c boolean, d boolean")
    A.audit(rows, list("abcd")).collect()
    assert sorted(visits) == list(range(15)) and max(most) == 4 and counted is A.Trie.counted
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    for wrong in ([], list("abcdefgh")):
        with pytest.raises(ValueError):
            A.audit(rows, wrong)


def test_verdicts_of_odd_rows(spark):
    word = " ".join(f"w{i}" for i in range(100))
    docs = [(1, word, "en"), (2, word, None), (2, word, ""), (None, word, "en"), (None, "only null ids", "en"), (3, None, "en"), (4, "", "en"), (5, "AB\x0bcd é", "en"), (6, "x " * 40_000 + "#", "en"), (7, word + " w1" * 30, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("A", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("good", F.lit(True))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = sorted((r.part, "".join(c for c in A.LETTERS if r[c]), r.good, r.toxic) for r in A.document_verdicts(df, labels).collect())
    want = [("en", "", True, True), ("", "E", None, None), ("", "E", None, None), ("en", "E", None, None), ("en", "A", None, None), ("en", "A", None, None), ("en", "AE", None, None), ("en", "AC", None, None), ("en", "BD", None, None), ("en", "B", None, None)]
    plain = lambda rows: sorted((p, f, bool(g), bool(t)) for p, f, g, t in rows)
    assert plain(got) == plain(want)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.spark_rows(A.op13_filter_audit(spark, sf)) == oracle.sql_rows(A.ORACLE, sf)

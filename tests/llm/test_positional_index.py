import random
import re
from collections import Counter

import oracle
import pytest

from ravelin.llm import positional_index as P


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def brute(docs, items, size, slop):
    """(n_words, n_hit, items with a phrase, items with a proximity match) of each text."""
    own, count = [words(t) for t in docs], Counter()
    for w in own:
        count.update(w)
    out = []
    for w in own:
        hit, phrase, close = set(), set(), set()
        for item, text in items:
            v = words(text)
            for window in {tuple(v[s : s + size]) for s in range(max(1, len(v) - size + 1))} if v else ():
                for s in range(len(w) - len(window) + 1):
                    if tuple(w[s : s + len(window)]) == window:
                        hit.update(range(s, s + len(window)))
                        phrase.add(item or "")
                least = min(window, key=lambda x: (count[x], x))
                if any(w[k] == least and set(window) <= set(w[max(0, k - slop) : k + slop + 1]) for k in range(len(w))):
                    close.add(item or "")
        out.append((len(w), len(hit), sorted(phrase), sorted(close)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    letters, between = ["a", "B", "b", "c", "é", "É", "d9", "İ", "x\U0001f600"][: 3 + 2 * seed], [" ", " - ", "\n", "\x00", "_"]
    text = lambda n: draw.choice(["", " ", "-"]) + "".join(draw.choice(letters) + draw.choice(between) for _ in range(draw.randrange(n)))
    items = [(k or None, text(14)) for k in range(8)] + [(3, "b b b"), (9, None), (9, ""), (10, "a"), (11, "absent here"), (10, "a")]
    docs = [text(60) for _ in range(25)] + [None, "", "a", items[0][1] + items[1][1]]
    rows = spark.createDataFrame([(k % 20 or None, t, "clash", 1) for k, t in enumerate(docs)], "doc_id long, text string, term string, uid int").repartition(3)
    tests = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, id int")
    size, slop = 4, 4 + seed
    got = P.decontaminate(rows, tests, size, slop).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = [(k % 20 or None, *b[:4], b[1] > 0) for k, b in enumerate(brute(docs, [(None if k is None else str(k), t) for k, t in items], size, slop))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r.n_hit for r in got) and any(set(r.near_items) - set(r["items"]) for r in got)


def test_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "one two three " * 30_000), (1, "One, TWO; three"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "three one two three")], "item_id string, text string")
    assert P.decontaminate(docs.limit(0), items).count() == 0
    none = P.decontaminate(docs, items.limit(0)).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in none) == [(0, 0, False), (3, 0, False), (90_000, 0, False)]
    got = P.decontaminate(docs, items).collect()
    assert sorted((r.n_words, r.n_hit, r["items"], r.near_items) for r in got) == [(0, 0, [], []), (3, 0, [], ["q"]), (90_000, 89_998, ["q"], ["q"])]


def test_plain_plans_only(spark):
    sf = "/root/testdata/sf0.001"
    plan = P.op12_positional_index(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.spark_rows(P.op12_positional_index(spark, sf)) == oracle.sql_rows(P.ORACLE, sf)

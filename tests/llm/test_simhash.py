import numpy as np
from xxhash import xxh64_intdigest

from ravelin.llm import simhash
from ravelin.llm.components import components


def brute_fp(text, n=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(texts):
    fps = {k: brute_fp(t) for k, t in texts}
    ids = sorted(fps)
    a = np.array([fps[k] for k in ids], np.uint64)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, k in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = sorted((find(k), find(ids[j])))
            root[y] = x
    return {(k, f"{fps[k]:016x}", find(k)) for k in ids}


def result(df):
    return {tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()}


def test_fixture(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e f"), (7, "A B  C\nd e f"), (8, "x y"), (9, "É é ß"), (10, "w " * 20000)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, fp string")
    assert result(simhash.near_duplicates(df)) == brute(texts)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.union(df)).count() == 2 * len(texts)


def test_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(simhash.op3_simhash(spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_links_of_planted_balls(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for d in (1, 2, 3, 4):
            for _ in range(6):
                fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in simhash.links(df).collect())
    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 3]:
            assert found[int(x.view(np.int64))] == found[int(y.view(np.int64))]


def test_code_words_of_balls():
    n = 0
    for side, found in simhash.changes():
        assert len(found) == len(set(found)) == ((1 if side < 2 else 32) if side % 2 == 0 else 652)
        n += len(found)
        for x in found[:50]:
            at = [i + 1 for i in range(63) if x >> i & 1]
            assert len(at) <= 2 + side % 2 and np.bitwise_xor.reduce([0, *at]) == side // 2
    assert n == 1 + 63 * 32 + 64 * 652


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}

import random

import numpy as np
import pytest

from ravelin.llm import jaccard
from ravelin.llm.components import components


def close(x, y):
    both = len(x & y)
    return 5 * both >= 4 * (len(x) + len(y) - both)


@pytest.mark.parametrize("seed", range(2))
def test_pivots_lose_no_link(spark, monkeypatch, seed):
    """One bucket of clusters, chains between them and strangers: edges of the rounds and of the rest join what brute force joins."""
    draw = random.Random(seed)
    sets = []
    for _ in range(3):
        base = set(draw.sample(range(1, 400), 60))
        for _ in range(6):
            own = set(base)
            for _ in range(draw.choice([0, 3, 6, 9])):
                own.discard(draw.choice(sorted(own)))
                own.add(draw.randrange(400, 900))
            sets.append(own)
            base = own if draw.random() < 0.5 else base
    sets += [set(draw.sample(range(1000, 2000), 50)) for _ in range(2)]
    raw = lambda s: np.array(sorted(s), np.uint64).tobytes()
    table = spark.createDataFrame([(k, bytearray(raw(s))) for k, s in enumerate(sets)], "content long, shingles binary")
    members = spark.createDataFrame([(7, k) for k in range(len(sets))] + [(8, 0), (8, 1)], "key long, content long")
    root = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if close(x, y):
                    root[a] = root[b] = min(root[a], root[b])
    for most, gain, rounds in ((1, -1.0, 2), (1 << 30, 0.02, 0), (len(sets) * 200, 0.3, 1)):
        monkeypatch.setattr(jaccard, "BUCKET_BYTES", most)
        monkeypatch.setattr(jaccard, "LEAST_GAIN", gain)
        left, edges = jaccard.without_linked(members, table)
        buckets = left.join(table, "content").select("key", "content", "shingles").repartition(2, "key").sortWithinPartitions("key", "content")
        found = buckets.mapInArrow(jaccard._edges, "a long, b long")
        for e in edges:
            found = found.union(e)
        rows = found.collect()
        assert all(close(sets[r.a], sets[r.b]) for r in rows) and len(edges) >= rounds
        got = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in rows], "a long, b long")).collect()}
        assert [got.get(k, k) for k in range(len(sets))] == root
        if most == 1 and gain < 0:
            assert left.count() == 0


def test_a_large_group_of_near_copies_leaves_its_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 10_000)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(0, 300, 4)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "uid long, text string")
    sizes = []
    real = jaccard.without_linked
    monkeypatch.setattr(jaccard, "without_linked", lambda m, s: sizes.append((m.count(), (out := real(m, s))[0].count())) or out)
    assert {r.component_id for r in jaccard.near_duplicates(df).collect()} == {0}
    assert sizes[0][1] < 0.2 * sizes[0][0]

import numpy as np

from ravelin.llm import chroma as C


def melody(seed, notes=60):
    return C.rendered(np.random.default_rng(seed).normal(0, 0.15, notes).tolist())


def error(a, b, offset):
    x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
    n = min(len(x), len(y))
    return np.bitwise_count((x[:n] ^ y[:n]).view(np.uint32)).sum() / (32 * n)


def test_filters_look_inside():
    assert len(C.filters()) == 16
    for sides in C.filters():
        for t, y, w, h in (r for s in sides for r in s):
            assert 0 <= t and t + w <= C.WIDTH and 0 <= y and y + h <= C.CLASSES + C.CLASSES // 2


def test_rectangles_by_brute_force():
    x = np.random.default_rng(0).random((40, 12))
    got = C.pack(x).view(np.uint32)
    wide = np.concatenate((x, x[:, :6]), axis=1)
    for t in range(len(got)):
        for k, (plus, minus) in enumerate(C.filters()):
            a, b = (np.concatenate([wide[t + f : t + f + w, y : y + h].ravel() for f, y, w, h in s]).mean() for s in (plus, minus))
            answer = sum((a - b) / (a + b + 1e-9) >= s for s in C.STEPS)
            assert got[t] >> np.uint32(2 * k) & np.uint32(3) == C.GRAY[answer]


def test_alignment_of_noisy_and_shifted(spark):
    one = melody(1)
    noisy = one + np.random.default_rng(5).normal(0, 0.1, len(one))
    late = np.concatenate((np.zeros(20 * C.HOP), one))
    rows = [(0, one.tolist()), (1, noisy.tolist()), (2, late.tolist()), (3, melody(2).tolist()), (4, one.tolist()), (5, None), (6, [0.0] * 5), (6, [0.0] * 5), (7, [float("nan")] * 9000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, audio array<double>, items int")
    got = C.search(C.fingerprints(df, "id", "audio"), lambda i: i % 100 == 0).collect()
    match = {r.class_id: r for r in got if r.kind == "match"}
    assert set(match) == {1, 2} and all(r.id == 0 for r in match.values())
    assert match[1].offset == 0 and match[2].offset == -20 and match[1].bit_error < 0.1
    a, b, c = (C.pack(C.pitch_classes(x)) for x in (one, noisy, late))
    assert abs(match[1].bit_error - error(a, b, 0)) < 1e-6 and abs(match[2].bit_error - error(a, c, -20)) < 1e-6
    members = sorted((r.id, r.class_id) for r in got if r.kind == "member")
    assert members == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 5), (6, 5), (6, 5), (7, 7)] and len(got) == len(rows) + 2
    assert C.search(C.fingerprints(df.limit(0), "id", "audio"), lambda i: i % 100 == 0).count() == 0
    prints = C.fingerprints(df.filter("id < 2"), "id", "audio")
    items = prints.filter("id = 0").select("items")
    odd = prints.union(items.selectExpr("cast(null as long)", "items")).union(items.selectExpr("cast(null as long)", "slice(items, 20, 400)")).union(items.selectExpr("9L", "cast(null as array<int>)"))
    found = C.search(odd.selectExpr("*", "1 AS other"), lambda i: i % 100 == 0).collect()
    assert sorted((str(r.id), r.class_id) for r in found if r.kind == "member" and r.class_id is not None) == [("0", 0), ("1", 1), ("None", 0)]
    assert [(r.id, r.class_id) for r in found if r.kind == "match"] == [(0, 1)] and sum(r.kind == "member" for r in found) == 4


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.15, (30, 64))
    vectors = np.concatenate((base, base + rng.normal(0, 0.002, base.shape)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = C.search(C.fingerprints(df, "vec_id", "embedding", C.rendered), lambda i: i < 30).collect()
    of = {r.id: r.class_id for r in rows if r.kind == "member"}
    matches = {(r.id, r.class_id) for r in rows if r.kind == "match"}
    got = {(i, j) for i in range(30) for j in range(60) if of[i] == of[j] or (of[i], of[j]) in matches}
    prints = [C.pack(C.pitch_classes(C.rendered(v.tolist()))) for v in vectors]
    want = {(i, j) for i in range(30) for j in range(60) if i != j and any(error(prints[i], prints[j], o) <= C.MOST_ERROR for o in range(-40, 41, 1))}
    assert len(want & got) >= 0.9 * len(want) and len(want) >= 25


def test_recall_up_to_the_most_error(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 0.15, (40, 64))
    rows = [(k, C.rendered(v.tolist())) for k, v in enumerate(base)]
    for n, noise in enumerate((0.02, 0.03, 0.04)):
        rows += [(100 * (n + 1) + k, C.rendered((v + rng.normal(0, noise, 64)).tolist())) for k, v in enumerate(base)]
    for k, v in enumerate(base):
        part = C.rendered(v.tolist())[int(60.4 * C.HOP) :]  # between two hops
        rows.append((400 + k, part + rng.normal(0, 0.1, len(part))))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in rows], "id long, audio array<double>")
    found = {(r.id, r.class_id) for r in C.search(C.fingerprints(df, "id", "audio"), lambda i: i < 40).collect() if r.kind == "match"}
    prints = {k: C.pack(C.pitch_classes(x)) for k, x in rows}

    def least(a, b):
        offsets = range(-len(b) + C.LEAST_OVERLAP, len(a) - C.LEAST_OVERLAP + 1)
        return min(error(a, b, o) for o in offsets)

    for n in range(1, 5):
        want = {(k, 100 * n + k) for k in range(40) if least(prints[k], prints[100 * n + k]) <= C.MOST_ERROR}
        assert len(want) >= 15 and len(want & found) >= 0.95 * len(want), n

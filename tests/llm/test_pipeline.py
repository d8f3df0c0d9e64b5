import corpus_pipeline
from ravelin.llm import fertility, pii
from ravelin.llm.common import materialise


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "sanitise", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "quality":
            kept = fertility.op2_fertility(spark, sf).filter("kept").select("doc_id").collect()
            assert after.keys() >= {r.doc_id for r in kept} and all(before[k] == r for k, r in after.items())
        if name == "near_dedup":
            assert after.keys() == {find(k) for find in [groups_of(before)] for k in before}
        if name == "repeats":
            assert after.keys() == before.keys() and all(len(r.text) <= len(before[k].text) and r.n_chars == len(r.text) for k, r in after.items())
        if name == "sanitise":
            assert after.keys() == before.keys() and not any(pii.base_spans(r.text) for r in after.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == before.keys() and all(len(r.ids) == r.length for r in pieces)


def test_odd_documents(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "_added", "_doc", "_hash", "_good_id", "_good_hash", "_id", "_lang", "_spans", "_gone", "_uid", "uid", "row", "base", "near", "term"]
    schema = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names)
    own = tuple(f"own {c}" for c in names[5:])
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "w " * 30000, "en", "s", 1), (2, "w " * 30000, "en", "s", 1), (None, None, "en", "s", 5)]
    rows += [(10 + k, f"note {k % 7} about things {chr(97 + k)} Zarquon keeps zark@mail.example {chr(98 + k)} here", "en", "s", 7) for k in range(6)]
    rows += [(100 + k, "common words about things here keeps note", "en", "s", 7) for k in range(600)]
    df = spark.createDataFrame([(*r, *own) for r in rows], schema)
    for some in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, "/root/testdata/sf0.001")
            got = out.collect()
            assert out.columns == df.columns and len(got) <= df.count()
            assert all(tuple(r)[5:] == own for r in got), name
            if name == "sanitise" and some is df:
                assert len(got) == len(rows) and sum("<EMAIL>" in (r.text or "") for r in got) == sum("<TERM>" in (r.text or "") for r in got) == 6
        assert corpus_pipeline.STAGES[-1][1](spark, some, "").count() >= (0 if some is not df else 4)


def shingles(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def groups_of(docs):
    """The least id of each document's group, by comparing all pairs."""
    sets = {k: shingles(r.text) for k, r in docs.items()}
    ids = sorted(sets)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return find


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(3, text, 1), (1, text, 2), (1, text, 2), (None, text, 3), (7, "something else altogether", 4), (None, "and no other like it", 5), (None, "and no other like it", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.uid) for r in got.collect()) == [(0, 5), (1, 2), (7, 4)]


def test_near_dedup_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    rows = {r.doc_id: r for r in docs.collect()}
    find = groups_of(rows)
    want = {k for k in rows if find(k) != k}
    assert len(want) >= 10
    gone = rows.keys() - {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert gone <= want and len(gone) >= 0.99 * len(want)

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import suffix_repeats as S


def brute(texts, least):
    """Digests by a set of every string that has started so far; texts: (doc_id, text) in order."""
    seen, out = set(), {}
    for doc, text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - least + 1):
            s = raw[a : a + least]
            if s in seen:
                gone[a : a + least] = True
            seen.add(s)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def maximal(texts, least):
    """Maximal repeats by comparing all substrings."""
    by = {}
    for t, x in enumerate(texts):
        for a in range(len(x)):
            for b in range(a + least, len(x) + 1):
                by.setdefault(x[a:b], []).append((t, a))
    out = []
    for s, at in by.items():
        if len(at) > 1:
            left = {texts[t][a - 1 : a] or (t,) for t, a in at}
            right = {texts[t][a + len(s) : a + len(s) + 1] or (t,) for t, a in at}
            if len(left) > 1 and len(right) > 1:
                out.append((len(s), sorted(at)))
    return sorted(out)


@given(st.lists(st.text("ab", max_size=14).map(str.encode), min_size=1, max_size=4), st.integers(2, 4))
@settings(deadline=None, max_examples=150)
def test_maximal_repeats(texts, least):
    assert sorted((n, sorted(at)) for n, at in S.repeats(texts, least)) == maximal(texts, least)


@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=5), st.integers(4, 7))
@settings(deadline=None, max_examples=150)
def test_later_occurrences(texts, least):
    raw = [t.encode() for t in texts]
    spans = {k: [] for k in range(len(raw))}
    for t, a, n in S.later_occurrences(raw, [(k, 0) for k in range(len(raw))], least):
        spans[t].append({"start": a, "end": a + n})
    want = brute(list(enumerate(texts)), least)
    for k, r in enumerate(raw):
        assert hashlib.sha256(S.kept(r, S.merged(spans[k]))).hexdigest() == want[k][3]


@given(st.lists(st.text("abc", max_size=60).map(str.encode), min_size=1, max_size=4), st.integers(8, 20))
@settings(deadline=None)
def test_pieces_cover_each_window_once(texts, least):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    h, at, until, more = S.pieces_of(data, bounds, least)
    windows = [k for a, b in zip(at, until) for k in range(a, b)]
    assert windows == [k for a, b in zip(bounds[:-1], bounds[1:]) for k in range(a, b - least + 1)]
    of = {}
    for x, a, b, m in zip(h, at, until, more):
        own = [bytes(data[k : k + least]) for k in range(a, b)]
        assert m or len(set(own)) == len(own)
        for k in range(a, b):
            assert of.setdefault(bytes(data[k : k + least]), x) == x


def corpus(n=120, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, line = prose(40), prose(15) + "."
    texts = []
    for k in range(n):
        t = prose(r.randint(5, 120))
        if k % 3 == 0:
            t = t[: len(t) // 2] + passage[r.randint(0, 30) :] + t[len(t) // 2 :]
        if k % 4 == 0:
            t += "\n" + line + "\n" + prose(3)
        if k % 7 == 0 and texts:
            t = r.choice(texts)
        if k % 11 == 0:
            t = "for " * r.randint(20, 90) + t
        texts.append(t)
    return texts


@pytest.mark.parametrize("most", [S.GROUP_BYTES, 400])
def test_corpus(spark, monkeypatch, most):
    monkeypatch.setattr(S, "GROUP_BYTES", most)
    texts = [*corpus(), None, "", "x" * 5000, "ab" * 3000]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(k, texts[k], 1) for k in order], "doc_id long, text string, uid int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df).collect()}
    assert got == brute(list(enumerate(texts)), 100)
    out = S.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(texts)
    assert S.remove_repeats(df.limit(0)).count() == 0


def dashes(n, seed=2):
    """Documents with a run of one character of some 20,000 bytes, or of a pattern, between words of their own."""
    r = random.Random(seed)
    return [f"{r.random()} {'-' * r.randint(19_000, 21_000)} {r.random()} {'=-' * r.randint(40, 400)}{r.random()}" for _ in range(n)]


def test_runs_of_one_character(spark):
    texts = dashes(60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df).collect()} == brute(list(enumerate(texts)), 100)


def test_many_runs_of_one_character_in_bounded_groups(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(S, "materialise", lambda df, name, real=S.materialise: tables.setdefault(name, real(df, name)))
    monkeypatch.setattr(S, "GROUP_BYTES", 1 << 16)
    texts = dashes(300, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df).collect()} == brute(list(enumerate(texts)), 100)
    groups = tables["pieces"].filter("not copy").groupBy("h").sum("bytes").collect()
    hot = {r.h for r in tables["hot"].collect()}
    assert hot and hot == {r.h for r in groups if r[1] > S.GROUP_BYTES} and not tables["windows"].isEmpty()


@given(st.lists(st.text("abc", max_size=60).map(str.encode), min_size=1, max_size=4), st.integers(8, 20), st.sampled_from([1, 2, 4]))
@settings(deadline=None)
def test_ranges_cover_each_string_once(texts, least, width):
    pieces = [(k, 7 * k, t) for k, t in enumerate(texts) if len(t) >= least]
    rows = S._ranges_of(pieces, least, width).to_pylist() if pieces else []
    own = lambda r: dict((k, t) for k, _, t in pieces)[r["uid"]][r["start"] - 7 * r["uid"] :][: r["bytes"]]
    assert all(r["piece"] == (None if r["copy"] else own(r)) for r in rows)
    of, got = {}, []
    for r in rows:
        for k in range(r["bytes"] - least + 1):
            got.append((r["uid"], r["start"] + k))
            assert of.setdefault(own(r)[k : k + least], r["h"]) == r["h"]
    assert sorted(got) == [(k, a + x) for k, a, t in pieces for x in range(len(t) - least + 1)]


def test_a_very_frequent_line_gives_few_rows_a_piece(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(S, "materialise", lambda df, name, real=S.materialise: tables.setdefault(name, real(df, name)))
    monkeypatch.setattr(S, "GROUP_BYTES", 1 << 13)
    r = random.Random(4)
    line = " ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(20))
    noise = lambda n: "".join(r.choice("klmnopqrstuvwxyz ") for _ in range(n))
    texts = [f"{noise(150)} {line} {noise(150)}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df).collect()} == brute(list(enumerate(texts)), 100)
    firsts = tables["pieces"].filter("not copy").join(tables["hot"], "h")
    rows = sum(t.count() for n, t in tables.items() if n.startswith("windows"))
    strings = firsts.selectExpr("sum(bytes - 99)").first()[0]
    assert firsts.count() > 300 and rows < strings / 4


def test_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    monkeypatch.setattr(S, "MOST_WINDOWS", 50)
    monkeypatch.setattr(S, "ARRAY_BYTES", 300)
    texts = [*corpus(40, 5), "z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df).collect()} == brute(list(enumerate(texts)), 100)


def test_repeated_and_null_ids(spark):
    text = "some words of a text that is long enough to hold a hundred bytes, which takes a while to write down here, yes"
    df = spark.createDataFrame([(1, text), (1, text), (1, "x" + text), (None, text), (None, None)], "doc_id long, text string")
    rows = S.remove_repeats(df).collect()
    assert len(rows) == 5 and sum(r.n_removed == 0 for r in rows if r.n_bytes == len(text) and r.doc_id == 1) in (0, 2)
    assert [r.n_removed for r in rows if r.doc_id is None and r.n_bytes] == [len(text)]


def test_sf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert {r.doc_id: tuple(r)[1:] for r in S.op7_suffix_repeats(spark, "/root/testdata/sf0.001").collect()} == brute([(r.doc_id, r.text) for r in docs], 100)

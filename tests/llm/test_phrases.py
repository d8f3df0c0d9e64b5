import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import phrases as P


def brute(docs, max_n, least, absorbed, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = [w for w in re.split(rb"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(len(words)):
                for m in range(1, max_n + 1):
                    if k + m <= len(words):
                        f[lang][tuple(words[k : k + m])] += 1
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = lambda o: any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1))  # noqa: B023, E731
            if any(len(o) > len(p) and 100 * b >= absorbed * a and inside(o) for o, b in candidates.items()):
                continue
            score, _, left, right = min((P.SCALE * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    words = ["a", "A", "b", "ab", "a\x01", "É", "é", " x", "|", "\x00", "the"][: 4 + 2 * seed]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "\t", "  ", ". ", "\n"]) for _ in range(draw.randrange(60)))
    docs = [(draw.choice(["en", "en", "en", "de", None, "und", ""]), text()) for _ in range(40)] + [("en", None), (None, ""), ("xx", " \n"), ("en", "a b A b " * 3_000)]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "lang string, text string, n int, phrase string").repartition(3)
    got = sorted(map(tuple, P.collocations(df, 2 + seed % 3, 3, 50, 25).collect()))
    assert got == brute(docs, 2 + seed % 3, 3, 50, 25) and got
    assert P.collocations(df.limit(0)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["en", "de"]), st.lists(st.sampled_from([b"a", b"ab", b"b", b"c\x00"]), min_size=1, max_size=3)), min_size=1, max_size=60), st.integers(1, 9), st.integers(1, 9))
def test_stack_in_any_batches(rows, size, least):
    keys = sorted({(lang, b"".join(w + P.MARK for w in r)) for lang, r in rows}, reverse=True)
    counts, got, hot = np.arange(1, len(keys) + 1), Counter(), frozenset([("en", b"a"), ("en", b"b")])
    stack = P.Stack(3, least, hot)

    def take(ended):
        for lang, phrases, n in ended:
            for key in zip(lang.to_pylist(), phrases.to_pylist(), n.tolist(), strict=True):
                assert key[:2] not in got
                got[key[:2]] = key[2]

    for a in range(0, len(keys), size):
        some = keys[a : a + size]
        take(stack.push(pa.array([k[0] for k in some]), pa.array([k[1] for k in some], pa.binary()), counts[a : a + size]))
    take(stack.drained())
    want = Counter()
    for (lang, key), n in zip(keys, counts.tolist(), strict=True):
        own = key.split(P.MARK)[:-1]
        for k in range(len(own)):
            want[lang, b" ".join(own[: k + 1])] += n
    assert got == {k: n for k, n in want.items() if n >= least or all((k[0], w) in hot for w in k[1].split(b" "))}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=5), max_size=6), st.integers(1, 4), st.booleans())
def test_distinct_suffixes(texts, max_n, wide):
    distinct, places = P.numbered(P.STOP.join(b" ".join(t) for t in texts))
    names = [None, *distinct.to_pylist()]
    words, counts = P.distinct_suffixes(places, 2**40 if wide else len(distinct), max_n)
    got = {tuple(names[w[k]] for w in words if w[k]): n for k, n in enumerate(counts.tolist())}
    assert got == Counter(tuple(t[k : k + max_n]) for t in texts for k in range(len(t)))


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 10)
    texts = ["aa bb cc dd ee ff. gg hh; ii", "x" * 30, "", "a. b. c. d. e. f. g"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "en"], "text": pa.array([t.encode() for t in texts])})
    got = Counter((lang, piece.strip()) for lang, text in P.chunks(iter([batch])) for piece in text.split(P.STOP) if piece.strip())
    assert got == Counter([("en", p) for p in (b"aa bb cc dd ee ff", b"gg hh", b"ii", *b"a b c d e f g".split())] + [("de", b"x" * 30)])


def test_hot_words_are_dealt_by_what_follows(spark):
    class Known:
        value = frozenset([("en", b"the"), ("en", b"of")])

    docs = spark.createDataFrame([("en", "the cat x. the cat y. the dog z. of the a. of the b. cat the a. cat of"), ("de", "the cat. the dog")], "lang string, text string")
    deal = {(r.lang, bytes(r.key)): r.deal for r in P.suffixes(docs, 3, Known).collect()}
    key = lambda words: b"".join(w + P.MARK for w in words.encode().split())
    of = lambda words, lang="en": deal[lang, key(words)]
    assert of("cat the a") == of("cat of") == of("cat x") and of("the cat x") == of("the cat y") != of("the dog z")
    assert of("of the a") != of("of the b") and of("the cat", "de") == of("the dog", "de")


def test_numbers_beyond_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1)], "lang string, phrase string, size int, f long")
    row = P.scored(P.unabsorbed(phrases), phrases).collect()
    assert [tuple(r) for r in row] == [("en", "a b", big, big + 7, big + 1, P.SCALE * big * big // ((big + 7) * (big + 1)))]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.spark_rows(P.op11_phrases(spark, sf)) == oracle.sql_rows(P.ORACLE, sf)

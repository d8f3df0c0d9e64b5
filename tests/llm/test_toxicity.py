import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ravelin.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


TERMS = {"abcde": 3.0, "bca": 2.0, "abcab": 4.0, "ccccca": 1.0}


@given(st.text("abcd", max_size=9))
def test_automaton_against_distances(word):
    exact = TERMS.get(word, 0.0)
    fuzzy = max([0.0, *(w for t, w in TERMS.items() if len(t) >= X.LEAST_FUZZY and distance(word, t) <= 1)])
    assert X.Automaton(X.Trie(TERMS)).weights(word) == (exact, 0.0 if exact else fuzzy)


def test_hits_by_kind():
    s = X.Scorer({"moron": 5.0, "scum": 5.0}, frozenset(["achli"]), frozenset(["moroc"]))
    assert s.counts("what a Moron you are, moron, scum") == (2, 0, 0, 0, 0, 6) and s.counts('the sign read "moron" in red, morxn') == (0, 1, 1, 0, 0, 7)
    assert s.counts("she said moron and moroon once") == (0, 0, 1, 1, 0, 6) and s.counts('a "moron" here and far and away from all of it, you moron') == (1, 0, 0, 0, 0, 11)
    assert s.counts("moroc scu scumm achli achlich achlixy") == (0, 0, 0, 0, 2, 6)
    assert s.counts(None) == s.counts("") == (0, 0, 0, 0, 0, 0) and s.counts("plain words") == (0, 0, 0, 0, 0, 2)


def test_bounds_of_factors_hold_whatever_the_labels_say():
    for edited in X.EDITED:
        for quoted in X.QUOTED:
            for steepness in X.STEEPNESS:
                m = X.Model({"moron": 5.0}, frozenset(), frozenset(), edited, quoted, steepness)
                none, one, two = m.score((0, 0, 0, 0, 0, 9)), m.score((0, 1, 0, 0, 0, 9)), m.score((1, 1, 0, 0, 0, 9))
                assert m.score((0, 0, 3, 0, 0, 9)) < 0.5 <= one < two and none < 0.5 and m.score((0, 0, 1, 0, 0, 9)) <= m.score((0, 0, 2, 1, 0, 9))
    y = np.array([0, 0, 1, 1, 1])
    assert np.allclose(X.regression(np.zeros((5, 1)), y, np.ones(5)), [0, np.log(3 / 2)], atol=1e-2)


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (5, "w " * 30000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = X.score(docs, X.fit(docs, known)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert X.score(docs.limit(0), X.fit(docs, labels)).count() == 0


@pytest.fixture(scope="module")
def result(spark):
    return X.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()


def test_held_out_accuracy(result):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in result)
    p, n = ([r.score for r in result if r.held_out and r.toxic == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert auc > 0.96 and sum(x >= 0.5 for x in p) / len(p) > 0.93 and sum(x >= 0.5 for x in n) / len(n) < 0.01


#: The beginnings of old novels and documents, and some sentences with words near the learned ones.
CLEAN = """It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife.
However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well fixed in the minds of the surrounding families.
It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness.
There were a king with a large jaw and a queen with a plain face, on the throne of England.
Call me Ishmael. Some years ago, having little or no money in my purse, I thought I would sail about a little and see the watery part of the world.
Alice was beginning to get very tired of sitting by her sister on the bank, and of having nothing to do.
Once or twice she had peeped into the book her sister was reading, but it had no pictures or conversations in it.
When in the Course of human events, it becomes necessary for one people to dissolve the political bands which have connected them with another.
We hold these truths to be self-evident, that all men are created equal.
Four score and seven years ago our fathers brought forth on this continent, a new nation, conceived in Liberty.
You don't know about me without you have read a book by the name of The Adventures of Tom Sawyer; but that ain't no matter.
To Sherlock Holmes she is always the woman. I have seldom heard him mention her under any other name.
Marley was dead: to begin with. There is no doubt whatever about that.
The sun shone, having no alternative, on the nothing new.
You will rejoice to hear that no disaster has accompanied the commencement of an enterprise which you have regarded with such evil forebodings.
No one would have believed in the last years of the nineteenth century that this world was being watched keenly and closely.
The Time Traveller was expounding a recondite matter to us, and his pale grey eyes shone and twinkled.
Happy families are all alike; every unhappy family is unhappy in its own way.
We close the more important works of the world.
Discuss the morning cloud and the distance to work.
The train was close and more people lost their path to work in the world.
The crown was lower and closer, blown by the wind; a crash, then the moon, and a study of stupor.
A worthy clerk was lost in the path of the cloud, more or less, and the traps were thrown to the brook.""".splitlines()


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    return X.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_words_whole_misspelled_and_quoted(model):
    words = {w for w in model.lexicon if len(w) >= X.LEAST_FUZZY}
    assert {"idiot", "stupid", "moron", "worthless", "pathetic", "clown", "loser", "trash", "disgusting"} <= words
    scorer = model.scorer(public_tokenizers.path(X.VOCABULARY))
    score = lambda text: model.score(scorer.counts(text))
    assert all(score(t) < 0.5 for t in [*CLEAN, " ".join(CLEAN), "", "x" * 100_000])
    n = missed = 0
    for w in words:
        assert score(f"You are a {w} here.") >= 0.5 > score(f'The sign read "{w}" in red.') and score(f"He said {w} once.") < 0.5
        for k in range(len(w)):
            for edited in (w[:k] + "x" + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + w[k + 1 :]):
                n += 1
                missed += score(f"You are a {edited} here.") < 0.5
                assert score(f"You are a {edited} here.") >= 0.5 or edited in scorer.ordinary
    print("FIGURES", len(words), n, missed)
    assert missed < 0.05 * n


def test_misspelled_in_held_out_documents(spark, model):
    sf = "/root/testdata/sf0.1"
    scorer = model.scorer(public_tokenizers.path(X.VOCABULARY))
    words = {w for w in model.lexicon if len(w) >= X.LEAST_FUZZY}
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1")
    n = caught = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").filter(X.in_fold("doc_id") == 0).select("text").collect():
        if hits := words & set(X.WORD.findall(r.text.lower())):
            n += 1
            caught += model.score(scorer.counts(re.sub("|".join(rf"\b{w}\b" for w in hits), lambda m: m[0][:2] + "x" + m[0][3:], r.text, flags=re.I))) >= 0.5
    assert n > 50 and caught >= 0.95 * n

"""Toxicity by a lexicon trie, met by a Levenshtein automaton, and the words around each hit.

The lexicon is learned from labelled documents: whole words that are so much likelier in toxic than in other texts, in either half of the
sample, that chance does not explain one among all words tried. Terms stand in a trie; a word meets it in the product of the trie and a
Levenshtein automaton of one edit, whose states are made when first reached and kept, so a word costs
a look-up per letter. Terms of LEAST_FUZZY letters or more may be one edit off, shorter ones must be exact; what is one edit off and yet a word of its own,
in a public vocabulary or in texts that are not toxic, is no misspelling.

A hit is quoted if quotation marks enclose it or a reporting word is within WINDOW words. A text's strength is one sum over its distinct hits: 1 for a direct one,
less for a misspelled one, and little for a quoted one. How much is learned from the labels, within bounds that hold whatever these say: a single misspelled hit is
beyond LEVEL and three quoted ones are not. The score is a logistic function of the strength, of learned steepness.

Where no single word tells, as in languages that build words from parts, beginnings of words may: those of BEGINNINGS letters that no term accounts for. One of them is no
hit; how many words have one, and their share of all words, is weighed by a regression, and the likelier of the two verdicts counts.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table

#: Labelled documents that the lexicon and the factors are fitted to: those of the least hashes of their ids.
SAMPLE_ROWS = 20_000
#: Parts of the sample: odds must hold in both.
HALVES = 2
#: Toxic documents that must have a term, and its log odds at least, in each half; words that chance alone may be expected to put into the lexicon.
LEAST_DOCUMENTS, LEAST_ODDS, BY_CHANCE = 4, 1.5, 0.5
#: Log odds of a word at least, and its share of the toxic documents that have its beginning, which must pass as well: one of many forms is no term.
WORD_ODDS, OWN_SHARE = 4.0, 0.5
#: Share of other than toxic documents, or one, that may hold a term or what would be taken for its misspelling; a term with more is dropped.
MOST_FALSE = 0.0005
#: Letters of beginnings.
BEGINNINGS = range(5, 9)
#: Terms of so many letters may be one edit off.
LEAST_FUZZY = 5
WINDOW = 6
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes term word reported reports claimed".split())
QUOTES = "\"'“”„«»‘’"
WORD = re.compile(r"[^\W\d_]+")
#: Other than toxic documents of the sample that make a word an ordinary one, and the vocabulary whose whole words are ordinary.
ORDINARY_DOCUMENTS, VOCABULARY = 2, "byte_bpe_50k.tiktoken"
#: Bounds of what a misspelled and a quoted hit count, and of the steepness; the strength of an even chance.
EDITED, QUOTED, STEEPNESS, LEVEL = (0.8, 1.0), (0.0, 0.2), (4.0, 20.0), 0.7
#: Words and automaton states that a worker keeps.
CACHE_WORDS, CACHE_STATES = 400_000, 200_000


class Trie:
    """Terms and their weights."""

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, float] = {}
        self.deep: list[int] = [0]
        for term, weight in weights.items():
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.deep.append(self.deep[node] + 1)
                node = self.children[node][c]
            self.whole[node] = max(weight, self.whole.get(node, 0.0))


class Automaton:
    """Deterministic product of a trie and the Levenshtein automaton of one edit; a state holds trie nodes by edits so far, and is made on demand."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[frozenset, frozenset]] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._number(frozenset([0]), frozenset(self.trie.children[0].values()))

    def _number(self, zero: frozenset, one: frozenset) -> int:
        key = zero, one
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        zero, one = self.states[state]
        children = self.trie.children
        exact = frozenset(children[n][c] for n in zero if c in children[n])
        edits = {children[n][c] for n in one if c in children[n]}
        for n in zero:
            edits.add(n)  # c is too much
            edits.update(children[n].values())  # c stands for another letter
        for n in exact:
            edits.update(children[n].values())  # a letter is missing
        return self._number(exact, frozenset(edits))

    def weights(self, word: str) -> tuple[float, float]:
        """Weight of the term that the word equals, and of the strongest of LEAST_FUZZY letters that is one edit off."""
        state = self.start
        for c in word:
            state, was = self.moves.get((state, c), -1), state
            if state < 0:
                state = self.moves[was, c] = self._move(was, c)
            if not any(self.states[state]):
                break
        zero, one = self.states[state]
        whole, deep = self.trie.whole, self.trie.deep
        exact = max([0.0, *(whole[n] for n in zero if n in whole)])
        fuzzy = max([0.0, *(whole[n] for n in one if n in whole and deep[n] >= LEAST_FUZZY)])
        if len(self.states) > CACHE_STATES:
            self.clear()
        return exact, (fuzzy if not exact else 0.0)


def vocabulary_words(path: str) -> set[str]:
    """Words that a vocabulary of byte tokens holds whole, behind a space."""
    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        return {w.lower() for t in tokens if t[:1] == b" " and WORD.fullmatch(w := t[1:].decode("utf-8", "ignore"))}


EXACT, NEAR, BEGINS = "exact", "near", "begins"


class Scorer:
    """Hits of whole texts in a lexicon. beginnings: beginnings of words; ordinary: words that are no misspelling of a term."""

    def __init__(self, weights: dict[str, float], beginnings: frozenset[str] = frozenset(), ordinary: frozenset[str] = frozenset()):
        self.automaton, self.beginnings, self.ordinary = Automaton(Trie(weights)), beginnings, ordinary
        self.hits: dict[str, str] = {}
        self.clean: set[str] = set()

    def learn(self, words: set[str]) -> dict[str, str]:
        """Words that are hits, and how."""
        for w in words - self.clean - self.hits.keys():
            exact, fuzzy = self.automaton.weights(w)
            if exact:
                self.hits[w] = EXACT
            elif any(w[:k] in self.beginnings for k in BEGINNINGS if k < len(w)):
                self.hits[w] = BEGINS
            elif fuzzy and w not in self.ordinary:
                self.hits[w] = NEAR
            else:
                self.clean.add(w)
        if len(self.clean) > CACHE_WORDS:
            self.clean = set()
        if len(self.hits) > CACHE_WORDS:
            self.hits = {w: self.hits[w] for w in words if w in self.hits}
        return self.hits

    def counts(self, text: str | None) -> tuple[int, ...]:
        """Distinct hits of a text: direct, direct and misspelled, quoted, quoted and misspelled; words of a known beginning; all words. A word that is direct anywhere is direct."""
        low = (text or "").lower()
        distinct = set(WORD.findall(low))
        hits = self.learn(distinct)
        own = {w: hits[w] for w in distinct if w in hits}
        begins = sum(how == BEGINS for how in own.values())
        if begins == len(own):
            return 0, 0, 0, 0, begins, len(distinct)
        found = list(WORD.finditer(low))
        quoted: dict[str, bool] = {}
        for k, m in enumerate(found):
            if own.get(m[0], BEGINS) != BEGINS and quoted.get(m[0], True):
                quoted[m[0]] = self.is_quoted(low, found, k)
        kinds = Counter((quoted[w], own[w]) for w in quoted)
        return kinds[False, EXACT], kinds[False, NEAR], kinds[True, EXACT], kinds[True, NEAR], begins, len(distinct)

    @staticmethod
    def is_quoted(text: str, words: list[re.Match], k: int) -> bool:
        near = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        if any(m[0] in REPORTING for m in near):
            return True
        a, b = words[max(0, k - WINDOW)].start(), words[min(len(words) - 1, k + WINDOW)].end()
        return any(q in QUOTES for q in text[a : words[k].start()]) and any(q in QUOTES for q in text[words[k].end() : b + 1])


class Model(NamedTuple):
    """lexicon: log odds of terms; ordinary: words of texts one edit from a term that are no misspelling; of_beginnings: weights of their number, of their share, and a constant."""

    lexicon: dict[str, float]
    ordinary: frozenset[str]
    beginnings: frozenset[str] = frozenset()
    edited: float = EDITED[0]
    quoted: float = QUOTED[1]
    steepness: float = STEEPNESS[0]
    of_beginnings: tuple[float, float, float] = (0.0, 0.0, -10.0)

    def scorer(self, path: str) -> Scorer:
        """The scorer of a worker, which reads the vocabulary at path."""
        near = Automaton(Trie(self.lexicon))
        return Scorer(self.lexicon, self.beginnings, self.ordinary | {w for w in vocabulary_words(path) if any(near.weights(w))})

    def strength(self, counts: tuple) -> float:
        direct, edited, quoted, both = counts[:4]
        return direct + self.edited * edited + self.quoted * (quoted + self.edited * both)

    def score(self, counts: tuple) -> float:
        z = self.steepness * (math.log1p(self.strength(counts)) - math.log1p(LEVEL))
        if counts[4]:
            a, b, c = self.of_beginnings
            x, y = of_begun(*counts[4:])
            z = max(z, a * x + b * y + c)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def of_begun(begins: int, words: int) -> tuple[float, float]:
    """What the regression sees of the words of a known beginning: their number and their share."""
    return math.log1p(begins), math.log1p(100 * begins / max(1, words))


def in_fold(doc_id):
    """crc32 of the id as text, mod 5: rows where it is 0 are held out. A null id is not."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold: text, toxic, half. Of several texts of one id the least is taken."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (in_fold("doc_id") != 0)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # at most `rows` pairs of numbers
    return materialise(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(HALVES)).alias("half")), "labelled")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, half, toxic, other): documents of rows (text, toxic, half) with each word, and with each beginning of words, which ends in *; summed in part by every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(dict.fromkeys((t, h) for t, h, _ in counts))
            of = lambda toxic: pa.array([counts[t, h, toxic] for t, h in keys], pa.int64())
            yield from pa.table({"term": pa.array([t for t, _ in keys], pa.string()), "half": pa.array([h for _, h in keys], pa.int64()), "toxic": of(True), "other": of(False)}).to_batches(20_000)
            counts.clear()

        for batch in batches:
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                words = set(WORD.findall((text or "").lower()))
                begins = {w[:k] + "*" for w in words for k in BEGINNINGS if k < len(w)}
                counts.update((w, half, toxic == 1) for w in words | begins)
            if len(counts) > CACHE_WORDS:
                yield from told()
        yield from told()

    return rows.mapInArrow(run, "term string, half long, toxic long, other long").groupBy("term", "half").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, tuple[int, float]], DataFrame]:
    """Log odds of the terms, beginnings with what chosen() needs, and the counts of all words. What passes the tests is as little as the sample's toxic vocabulary."""
    n = {r.half: r for r in rows.groupBy("half").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") != 1).alias("other")).collect()}
    toxic, other = sum(r.toxic for r in n.values()), sum(r.other for r in n.values())
    counts = materialise(term_counts(rows), "terms")
    if not toxic or not other or len(n) < HALVES:
        return {}, {}, counts
    odds = lambda a, b, x, y: F.log((a + 0.5) / (F.lit(x) + 1)) - F.log((b + 0.5) / (F.lit(y) + 1))
    column = lambda c, h: F.coalesce(F.max(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}")
    both = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"), *[column(c, h) for c in ("toxic", "other") for h in range(HALVES)]).filter(F.col("a") + F.col("b") >= LEAST_DOCUMENTS)
    a, b = F.col("a"), F.col("b")
    part = lambda k, of: F.when(k > 0, k * F.log(k / ((a + b) * of))).otherwise(0.0)
    share = toxic / (toxic + other)
    ratio = 2 * (part(a, share) + part(b, 1 - share))  # log-likelihood ratio: its chance falls as exp(-ratio / 2)
    tried = both.count()
    kept = both.withColumn("ratio", ratio).filter((a >= LEAST_DOCUMENTS) & (F.col("ratio") >= 2 * math.log(max(1.0, tried / BY_CHANCE))))
    for h in range(HALVES):
        kept = kept.filter(odds(F.col(f"toxic{h}"), F.col(f"other{h}"), n[h].toxic, n[h].other) >= LEAST_ODDS)
    found = {r.term: r for r in kept.select("term", "a", "ratio", odds(a, b, toxic, other).alias("odds")).collect()}
    stem = lambda w: found.get(w[: BEGINNINGS[0]] + "*") if len(w) > BEGINNINGS[0] else found[w]
    lexicon = {w: r.odds for w, r in found.items() if w[-1] != "*" and r.odds >= WORD_ODDS and stem(w) and r.a >= OWN_SHARE * stem(w).a}
    return lexicon, {t: (r.a, r.ratio) for t, r in found.items() if t[-1] == "*"} | {w: (found[w].a, 0.0) for w in lexicon}, counts


def chosen(begins: dict[str, tuple[int, float]], lexicon: dict[str, float]) -> set[str]:
    """Of the beginnings, those that tell most, of any two where one begins with the other the better one, and none that a term accounts for. begins: toxic documents and ratio of each, and of terms."""
    out: set[str] = set()
    for t in sorted((t for t in begins if t[-1] == "*"), key=lambda t: (-begins[t][1], t)):
        own = t[:-1]
        nested = any(own.startswith(x) or x.startswith(own) for x in out)
        if not nested and not any(w.startswith(own) and begins[w][0] >= OWN_SHARE * begins[t][0] for w in lexicon):
            out.add(own)
    return out


def regression(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a ridge, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weights * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def steepness(strength: np.ndarray, y: np.ndarray) -> float:
    """Of the logistic curve through LEVEL that makes the labels likeliest, within its bounds."""
    x = np.log1p(strength) - math.log1p(LEVEL)
    loss = lambda k: np.logaddexp(0, np.where(y, -k, k) * x).sum()
    return float(min(np.linspace(*STEEPNESS, 81), key=loss))


def fit(docs: DataFrame, labels: DataFrame, path: str | None = None) -> Model:
    """Lexicon, ordinary words and factors from labelled documents outside the held-out fold.

    At most SAMPLE_ROWS documents are read. Labels of null, or of a null id, do not count; of several labels of an id the greatest does, of several texts the least. Null and empty texts have
    no words. With labels of one class, or none, the lexicon is empty and all texts score alike, below a half. Long texts are read whole; columns of other names are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = sample(docs, labels)
    lexicon, begins, words = fit_lexicon(rows)
    if not lexicon and not begins:
        return Model({}, frozenset())

    tried = lexicon

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Automaton(Trie(tried))
        for batch in batches:
            yield batch.filter(pa.array([trie.weights(w)[1] > 0 for w in batch.column("term").to_pylist()], pa.bool_()))

    known = words.filter(~F.endswith("term", F.lit("*"))).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    close = known.mapInArrow(near, known.schema).collect()  # words of the sample one edit from a term
    ordinary = frozenset(r.term for r in close if r.other >= ORDINARY_DOCUMENTS and r.other > r.toxic)
    own = vocabulary_words(path) | ordinary
    trie, false = {t: Automaton(Trie({t: 1.0})) for t in lexicon}, Counter({r.term: r.other for r in known.filter(F.col("term").isin(list(lexicon))).collect()})
    for r in close:
        false.update({t: r.other for t in lexicon if r.term not in own and trie[t].weights(r.term)[1]})
    most = max(1, MOST_FALSE * rows.filter("toxic <> 1").count())
    lexicon = {t: w for t, w in lexicon.items() if false[t] <= most}
    beginnings = chosen(begins, lexicon)
    model = Model(lexicon, ordinary, frozenset(beginnings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([scorer.counts(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64())), "toxic": batch.column("toxic").cast(pa.int64())})

    got = rows.select("text", "toxic").mapInArrow(run, "x array<long>, toxic long").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()  # of SAMPLE_ROWS at most
    x, y, n = np.array([r.x for r in got]), np.array([r.toxic == 1 for r in got]), np.array([r["count"] for r in got])
    share = lambda rows: ((n * y)[rows].sum() + 1) / (n[rows].sum() + 2)  # noqa: E731  of toxic texts, drawn towards a half
    direct, edited, quoted = x[:, 0] > 0, (x[:, 0] == 0) & (x[:, 1] > 0), (x[:, 0] + x[:, 1] == 0) & (x[:, 2] + x[:, 3] > 0)
    factor = lambda rows, bounds: float(np.clip(share(rows) / share(direct), *bounds))
    model = model._replace(edited=factor(edited, EDITED), quoted=factor(quoted, QUOTED))
    plain = np.flatnonzero(x[:, 4] == 0)
    model = model._replace(steepness=steepness(np.repeat([model.strength(r) for r in x[plain]], n[plain]), np.repeat(y[plain], n[plain])))
    begun = np.flatnonzero((x[:, 4] > 0) & ~direct & ~edited)
    if len(begun):
        a, b, c = regression(np.array([of_begun(*r[4:]) for r in x[begun].tolist()]), y[begun], n[begun])
        model = model._replace(of_beginnings=(max(0.0, float(a)), max(0.0, float(b)), float(c)))
    return model


def score(docs: DataFrame, model: Model, path: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted. The score is the text's alone.

    Null and empty texts have no hits and so the score of any text without. Long texts are read whole; repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array([model.score(scorer.counts(t)) for t in batch.column("text").to_pylist()], pa.float64())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(in_fold("doc_id") == 0, F.lit(False)))
    return own.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

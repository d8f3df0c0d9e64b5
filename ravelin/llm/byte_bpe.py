"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

A text's matches of the splitting pattern are words; a worker encodes each distinct word once, at first
a token per byte. A recursive DuckDB query unfolds the words to rows (word, position, pair of tokens),
joins them with the merge table, and contracts in every word the leftmost pair of the least rank,
until no word has a pair left. Ordered aggregation decodes each word's ids by the vocabulary, and a
second one joins the ids and the texts of each document's words. The DuckDB database is in memory, bounded, and
holds one batch of words or texts at a time.

That query takes a pass over a word for every merge. Words of over LONG bytes have a second recursive query, which
contracts all places of the least pair in one pass, from the left. One by one gives the same: every token is what its
own bytes contract to, so a merge never opens a lesser pair with what comes after it. It keeps only the last state of a word.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 256
#: Distinct words a worker keeps, and encodes in one query.
CACHE_WORDS, AT_ONCE = 800_000, 60_000
#: Bytes of texts that one query puts together.
BATCH_BYTES = 4 << 20
#: The public pattern of byte-level vocabularies, and what it comes to for texts of PLAIN characters.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile(r"[\t\n\r -~¡-±´-¸º»¿-ž]*")
PLAIN_WORD = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ž]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
#: SHA-256 of no bytes.
NOTHING = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

WORDS = """
WITH RECURSIVE contract(word, tokens, open) AS (
    SELECT word, tokens, true FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT word, generate_subscripts(tokens, 1) AS position,
               unnest(list_transform(list_zip(tokens, tokens[2:]), lambda x: x[1] * 65536 + x[2])) AS pair
        FROM contract WHERE open
    ), least AS (
        SELECT p.word, min(m.merged * 65536 + p.position) AS best FROM pairs p JOIN merges m ON p.pair = m.pair GROUP BY p.word
    )
    SELECT c.word,
           CASE WHEN best IS NULL THEN tokens ELSE tokens[:(best & 65535) - 1] || [best >> 16] || tokens[(best & 65535) + 2:] END,
           best IS NOT NULL
    FROM contract c LEFT JOIN least l ON l.word = c.word WHERE c.open)
)
SELECT d.word, array_to_string(d.tokens, ' ') AS ids, len(d.tokens) AS n, t.text
FROM (SELECT word, tokens FROM contract WHERE NOT open) d JOIN (
    SELECT u.word, decode(unhex(string_agg(v.bytes, '' ORDER BY u.position))) AS text
    FROM (SELECT word, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS position FROM contract WHERE NOT open) u
    JOIN vocabulary v ON v.token = u.token GROUP BY u.word
) t ON t.word = d.word
"""
LONG_WORDS = """
WITH RECURSIVE contract(word, tokens, pass) USING KEY (word) AS (
    SELECT word, tokens, 0 FROM start
    UNION
    (WITH places AS (
        SELECT word, pass, generate_subscripts(tokens, 1) AS position, unnest(tokens) AS token,
               unnest(list_transform(list_zip(tokens, tokens[2:]), lambda x: x[1] * 65536 + x[2])) AS pair
        FROM contract
    ), ranked AS (
        SELECT p.*, m.merged FROM places p LEFT JOIN merges m ON p.pair = m.pair
    ), least AS (
        SELECT word, min(merged) AS merged FROM ranked GROUP BY word HAVING min(merged) IS NOT NULL
    ), found AS (
        SELECT r.word, r.position, r.position - row_number() OVER (PARTITION BY r.word ORDER BY r.position) AS run
        FROM ranked r JOIN least l ON r.word = l.word AND r.merged = l.merged
    ), chosen AS (
        SELECT word, position FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY position) AS n FROM found) WHERE n % 2 = 1
    )
    SELECT r.word, list(CASE WHEN c.word IS NULL THEN r.token ELSE l.merged END ORDER BY r.position), any_value(r.pass) + 1
    FROM ranked r JOIN least l ON l.word = r.word
    LEFT JOIN chosen c ON c.word = r.word AND c.position = r.position
    LEFT JOIN chosen b ON b.word = r.word AND b.position = r.position - 1
    WHERE b.word IS NULL GROUP BY r.word)
)
SELECT word, tokens FROM contract
"""
DOCUMENTS = """
SELECT d.doc, sum(w.n), sha256(string_agg(w.ids, ' ' ORDER BY d.position)), sha256(string_agg(w.text, '' ORDER BY d.position))
FROM parts d JOIN words w ON w.word = d.word GROUP BY d.doc
"""


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes texts by a rank file; see the module."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = ranks_of(path)
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.pattern, self.plain = regex.compile(pattern), pattern == PUBLIC_PATTERN
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "350MB", "preserve_insertion_order": False})
        self.merges = {}
        for whole, rank in self.ranks.items():
            for k in range(1, len(whole)):
                a, b = self.ranks.get(whole[:k]), self.ranks.get(whole[k:])
                if a is not None and b is not None:
                    self.merges[a * 65536 + b] = rank
        merges = pa.table({"pair": pa.array(self.merges.keys(), pa.int64()), "merged": pa.array(self.merges.values(), pa.int64())})  # noqa: F841
        vocabulary = pa.table({"token": pa.array(self.tokens.keys(), pa.int64()), "bytes": [t.hex() for t in self.tokens.values()]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: ids, their number, and the decoded text of each word.
        self.known: dict[str, tuple[str, int, str]] = {}

    def _start(self, tokens: list[np.ndarray]) -> pa.Table:
        at = np.cumsum([0, *map(len, tokens)])
        return pa.table({"word": pa.array(np.arange(len(tokens))), "tokens": pa.LargeListArray.from_arrays(at, pa.array(np.concatenate(tokens)))})

    def _encode(self, words: list[str]) -> None:
        # a word that is a token is that token alone, as the library has it
        tokens = [np.array([r]) if (r := self.ranks.get(b)) is not None else self.of_byte[np.frombuffer(b, np.uint8)] for b in (w.encode("utf-8", "replace") for w in words)]
        if long := [k for k, t in enumerate(tokens) if len(t) > LONG]:
            for k, ids in self._ask(LONG_WORDS, start=self._start([tokens[k] for k in long])):
                tokens[long[k]] = np.array(ids)
        for k, ids, n, text in self._ask(WORDS, start=self._start(tokens)):
            self.known[words[k]] = (ids, n, words[k] if text == words[k] else text)

    def _ask(self, query: str, **tables: pa.Table) -> list[tuple]:
        for name, rows in tables.items():
            self.db.register(name, rows)
        got = self.db.execute(query).fetchall()
        for name in tables:
            self.db.unregister(name)
        return got

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS and self.known:
            self.known, new = {}, words
        new = list(new)
        for a in range(0, len(new), AT_ONCE):
            self._encode(new[a : a + AT_ONCE])

    def split(self, text: str) -> list[str]:
        """The pattern's matches; for texts of plain characters by what the public pattern comes to for them."""
        return PLAIN_WORD.findall(text) if self.plain and PLAIN.fullmatch(text) else self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.known[w][0].split(" ")]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        split = [self.split(t) if t else [] for t in texts]
        distinct = set().union(*split)
        self.learn(distinct)
        known, number = self.known, {w: k for k, w in enumerate(distinct)}
        size = np.fromiter(map(len, split), np.int64, len(split))
        own = [known[w] for w in number]
        words = {"word": pa.array(np.arange(len(number), dtype=np.int32)), "ids": pa.array([x[0] for x in own], pa.string()), "n": pa.array([x[1] for x in own], pa.int64()), "text": pa.array([x[2] for x in own], pa.string())}
        parts = {
            "doc": pa.array(np.repeat(np.arange(len(split), dtype=np.int32), size)),
            "position": pa.array(np.arange(size.sum(), dtype=np.int32)),
            "word": pa.array(np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int32, size.sum())),
        }
        done = {doc: (int(n), ids, text) for doc, n, ids, text in self._ask(DOCUMENTS, words=pa.table(words), parts=pa.table(parts))}
        return [done.get(k, (0, NOTHING, NOTHING)) for k in range(len(split))]


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes docs (doc_id, text) and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of nothing. Strings of special tokens are
    ordinary text. Repeated rows and null ids give a row each; an empty table gives none. Long texts are
    encoded whole, long words as the module says; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size < BATCH_BYTES):
                    size += len(texts[b] or "")
                    b += 1
                rows = own.digests(texts[a:b])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a)} | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())))})
                a = b

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), P.path(VOCABULARY), P.PATTERN)

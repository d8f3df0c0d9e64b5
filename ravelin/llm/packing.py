"""Cost-balanced packing of token sequences.

A document of n tokens costs n + n * n / QUADRATIC: the linear part of a transformer layer and the
attention within the document. Descending by cost, each document goes to the sequence of the lowest
cost so far that still has room for all of it; where none has, it is cut to fill the open sequence of the
most room, the cheapest of equally roomy ones. Documents are packed in blocks of consecutive rows of one input partition, so
nothing is shuffled, memory is bounded by BLOCK_SEQUENCES * SEQUENCE tokens, and a lost task redoes
only its own partition with the same result. What overflows a block's whole sequences is carried into
the next block; the last block of a partition fills sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import WordEncoder, pieces, table

SEQUENCE = 4096
#: Tokens at which the attention cost of a document equals its linear cost.
QUADRATIC = 4096
#: Sequences that are filled at a time.
BLOCK_SEQUENCES = 256
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Texts of these characters alone are split here, by what the tokenizer's own pattern comes to for
#: them in lower case; other texts, which need its normal forms and classes, are left to it.
PLAIN = re.compile(r"[\t\n\r -~¡-±´-¸º»¿-įı-ňŊ-ž]*")
WORD = re.compile(r"[a-zªµºß-öø-ž]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷]+")

#: Characters of a part of a long text, and of the texts that are split at a time.
PART, AT_ONCE = 1 << 18, 1 << 20
CUT = re.compile(r"[ \n](?=[!-~])")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
PIECES = SCHEMA.removesuffix(", ids array<int>")


class Tokens:
    """Whole texts to ids of the word-end vocabulary, equal to the tokenizer's own encoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        #: Strings of special tokens; texts that hold one are left to the tokenizer, which gives their ids.
        self.special = re.compile("|".join(re.escape(t.content) for t in self.own.get_added_tokens_decoder().values()) or "(?!)", re.I)
        vocab = self.own.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = WordEncoder(self._encode)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words end where a token with the end mark does, so many are encoded at once."""
        out: list[bytes] = []
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.array(self.own.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            got = pieces(ids, self.ends[ids])
            if len(got) != len(part):  # a word that the tokenizer splits otherwise
                got = [np.array(self.own.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in part]
            out += got
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of little-endian uint32. Long texts are encoded in parts, so memory does not follow their length."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for (k, _), ids in zip(held, self._encode_texts([p for _, p in held]), strict=True):
                out[k].append(ids)
            held.clear()
            size = 0

        for k, text in enumerate(texts):
            for part in parts_of(text or ""):
                held.append((k, part))
                size += len(part)
                if size > AT_ONCE:
                    flush()
        flush()
        return [b"".join(x) for x in out]

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        split = [WORD.findall(t.lower()) if t and PLAIN.fullmatch(t) and not self.special.search(t) else None for t in texts]
        known = self.words.learn({w for ws in split if ws for w in ws})
        return [
            b"".join(map(known.__getitem__, ws)) if ws is not None else np.array(self.own.encode(t, add_special_tokens=False).ids if t else [], "<u4").tobytes()
            for t, ws in zip(texts, split, strict=True)
        ]


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut before an ASCII character that follows a space or line feed.

    No token reaches over white space, and neither lower case nor normal form looks over such a cut.
    """
    at = 0
    while len(text) - at > PART and (m := CUT.search(text, at + PART)):
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:] if at else text


@functools.lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def pack(lengths: list[int], rooms: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, in sequences
    with these rooms, which together hold them exactly or with space left.

    Ties: of documents of one length the first comes first, of sequences of one cost the first.
    Documents of length 0 give no piece.
    """
    left, out = list(rooms), []
    heap = [(0.0, k) for k in range(len(rooms))]
    order = sorted((k for k, n in enumerate(lengths) if n), key=lambda k: (-lengths[k], k))

    def put(doc: int, start: int, n: int, spent: float, k: int) -> None:
        out.append((doc, start, n, k, rooms[k] - left[k]))
        left[k] -= n
        if left[k]:
            heapq.heappush(heap, (spent + cost(n), k))

    for doc in order:
        start, n = 0, lengths[doc]
        while n:
            skipped, found = [], None
            while heap:
                c, k = heapq.heappop(heap)
                if left[k] >= n:
                    found = c, k
                    break
                skipped.append((c, k))
            if found is None:  # fits nowhere as a whole: fill the roomiest of the cheapest sequences
                at = max(range(len(skipped)), key=lambda i: (left[skipped[i][1]], -skipped[i][0], -skipped[i][1]))
                found = skipped.pop(at)
            for x in skipped:
                heapq.heappush(heap, x)
            c, k = found
            m = min(n, left[k])
            put(doc, start, m, c, k)
            start, n = start + m, n - m
    return out


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _partition(batches: Iterator[pa.RecordBatch], path: str, whole: bool, sequence: int, block: int) -> Iterator[pa.RecordBatch]:
    coder, end = tokens(path), np.array([END_ID], "<u4").tobytes()
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    waiting: list[tuple[int, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids
    total = 0

    def flush(rooms: list[int]) -> pa.RecordBatch:
        nonlocal waiting, number, total
        done = pack([len(x[3]) // 4 for x in waiting], rooms)
        done.sort(key=lambda p: (p[3], p[4]))
        cuts = [waiting[d][3][4 * s : 4 * (s + n)] for d, s, n, _, _ in done]
        cols = {
            "doc_id": pa.array([waiting[p[0]][0] for p in done], pa.int64()),
            "start": pa.array([waiting[p[0]][1] + p[1] for p in done], pa.int64()),
            "length": pa.array([p[2] for p in done], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
            "doc_tokens": pa.array([waiting[p[0]][2] for p in done], pa.int64()),
            "sequence_id": pa.array([number + p[3] for p in done], pa.int64()),
            "offset": pa.array([p[4] for p in done], pa.int64()),
        }
        if whole:
            flat = np.frombuffer(b"".join(cuts), "<u4").astype(np.int32)
            cols["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *(p[2] for p in done)]).astype(np.int32), flat)
        number += len(rooms)
        waiting, total = [], 0
        return pa.RecordBatch.from_pydict(cols)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a in range(0, len(texts), 256):
            for doc, got in zip(ids[a : a + 256], coder.encode(texts[a : a + 256]), strict=True):
                got += end
                n, start = len(got) // 4, 0
                while total + n - start >= sequence * block:  # the rest of the document opens the next block
                    m = sequence * block - total
                    waiting.append((doc, start, n, got[4 * start : 4 * (start + m)]))
                    start += m
                    yield flush([sequence] * block)
                if start < n:
                    waiting.append((doc, start, n, got[4 * start :]))
                    total += n - start
    if total:
        yield flush([sequence] * (total // sequence) + powers(total % sequence))


def pack_documents(docs: DataFrame, path: str, with_ids: bool = False, sequence: int = SEQUENCE, block: int = BLOCK_SEQUENCES) -> DataFrame:
    """Packs docs (doc_id long, text string) into sequences of at most `sequence` tokens.

    Each document's ids are its text's, by the tokenizers file at path as it is (the string of a special token is that
    token), then END_ID; a null or empty text is END_ID alone. Long texts are encoded in parts; of documents of equal cost the first goes first.
    Returns a row per piece: doc_id, start, length, ids_crc32 (of its ids as little-endian uint32),
    doc_tokens, sequence_id (unique), offset (of the piece in its sequence), and with_ids the ids.
    Offsets are gapless from 0. A row whose doc_id is null or repeated is packed like any other. An
    empty table gives no rows. Other columns of docs are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _partition(it, path, with_ids, sequence, block), SCHEMA if with_ids else PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of at most RADIUS = 3 differing bits meet half-way: at an odd distance one has an even and the
other an odd number of bits set, so it is enough that even fingerprints emit variants of one changed bit
and odd ones of two; at distance two both emit one. Of these balls only what a perfect code needs is emitted: a variant
stands for the word of the Hamming code of 63 bits next to it, at most one bit away. So an even fingerprint emits
all code words within two bits of itself (32 at most) and an odd one all within three (652), where the full balls of
one and two bits have 65 and 2081 variants and a shuffle that the disk cannot hold. The code words are as wide as the
fingerprint, so keys stay selective however many documents there are. They are shuffled, and the fingerprints of a key
are verified by all 64 bits. A key is linked by
a spanning tree of its verified pairs, never by all of them, so rows stay linear in groups of copies;
exact copies are one fingerprint and never meet. Nothing is capped: one key has at most the 83,456 fingerprints
within three bits of its code word, the sign bit free, 8 bytes each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import jaccard
from ravelin.llm.common import majority, materialise, table
from ravelin.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bits of the code: bit b is position b + 1 of the Hamming code, whose syndrome is the exclusive or of set positions.
CODE_BITS = 63
CODE = (1 << CODE_BITS) - 1


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased words' n-shingles, as a signed number; 0 without words.

    A bit is set if it is in over half of the shingles' XXH64.
    """
    from xxhash import xxh64_intdigest as digest

    if not text:
        return 0
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    return majority(hashes)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of docs (doc_id, text); null and empty texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array([fingerprint(t, n) for t in b.column("text").to_pylist()], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the pairs of distinct fingerprints at most radius bits apart."""
    if len(fps) == 2:
        return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= radius else []
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            found = rest[near].tolist()
            out += [(at, x) for x in found]
            queue += found
            rest = rest[~near]
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows (key, fp) sorted by key."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(cut, len(keys)))
        two = cut[size == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS] if len(two) else two
        a, b = [fps[two]], [fps[two + 1]]
        for k in np.flatnonzero(size > 2):
            own = np.unique(fps[cut[k] : cut[k] + size[k]])
            if found := bucket_links(own):
                x, y = np.array(found).T
                a.append(own[x])
                b.append(own[y])
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
        return pa.RecordBatch.from_pydict({"a": pairs[0].view(np.int64), "b": pairs[1].view(np.int64)}) if pairs.size else None

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if held and held[0][0][0] == keys[-1]:
            held.append((keys, fps))
            continue
        done = [*held, (keys[:last], fps[:last])]
        if out := edges(np.concatenate([k for k, _ in done]), np.concatenate([f for _, f in done])) if sum(len(k) for k, _ in done) else None:
            yield out
        held = [(keys[last:], fps[last:])]
    if held and (out := edges(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))):
        yield out


def changes() -> list[tuple[int, list[int]]]:
    """(side, changes): side is twice the syndrome of a fingerprint's CODE bits plus their parity; changes are the bits that turn it into each code word within two bits, or three if odd."""
    by: dict[int, list[list[int]]] = {s: [[], []] for s in range(CODE_BITS + 1)}
    for n in range(4):
        for at in combinations(range(1, CODE_BITS + 1), n):
            syndrome = functools.reduce(int.__xor__, at, 0)
            change = sum(1 << i - 1 for i in at)
            by[syndrome][1].append(change)
            if n < 3:
                by[syndrome][0].append(change)
    return [(2 * s + odd, by[s][odd]) for s in by for odd in (0, 1)]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of fingerprints (fp, distinct): every two at most RADIUS bits apart are joined by a chain of edges, and every edge is such a pair."""
    spark = distinct.sparkSession
    bits = lambda mask: F.bit_count(F.col("fp").bitwiseAND(F.lit(mask))).bitwiseAND(1)
    syndrome = [F.shiftleft(bits(sum(1 << i - 1 for i in range(1, CODE_BITS + 1) if i >> b & 1)), b + 1) for b in range(6)]
    side = functools.reduce(lambda x, y: x + y, syndrome, bits(CODE)).cast("int")
    table_of = spark.createDataFrame(changes(), "side int, changes array<long>")  # 128 rows, 44,000 numbers, whatever the data
    rows = distinct.withColumn("side", side).join(F.broadcast(table_of), "side").select("fp", F.explode("changes").alias("change"))
    keys = rows.select(F.col("fp").bitwiseAND(F.lit(CODE)).bitwiseXOR(F.col("change")).alias("key"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_buckets, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are runs of other than space and \\t to \\r, A-Z lower-cased; fewer words than n form one
    shingle, and long texts are read whole. Texts without words (null, empty, blank) have fingerprint 0 and link like any other.
    component_id is the least doc_id reachable by links of at most RADIUS bits, itself included. A
    null doc_id gets the component's id, or null if it has no other. Repeated rows give repeated
    rows; an empty table gives none; other columns are ignored.
    """
    fps = materialise(fingerprints(docs, n), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = materialise(components(links(distinct.select("fp"))), "components")
    roots = materialise(found.join(distinct, found.node == distinct.fp).groupBy("root").agg(F.min("least").alias("component_id")), "roots")  # alone in the join below, so that a root of very many can be split
    of_fp = found.join(roots, "root").select(F.col("node").alias("linked"), "component_id")
    own = distinct.join(of_fp, distinct.fp == F.col("linked"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    own = materialise(own, "components")  # so that the join below stands alone, and a fingerprint of very many copies can be split
    return fps.join(own, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_texts(docs: DataFrame) -> DataFrame:
    """(uid, component_id) per row of docs (uid long, text): groups of five-word shingles of Jaccard similarity 0.8 or more.

    Balls around the fingerprints of the five-word shingles propose pairs, which are verified by their shingles. At that similarity most
    fingerprints differ by more bits than any ball that could be emitted, so MinHash bands propose the rest; see jaccard.
    """
    return jaccard.near_duplicates(docs, links)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Verification of near-duplicates by the Jaccard similarity of five-word shingles, and what SimHash balls cannot propose.

Texts of similarity 0.8 differ by some ten of the 64 bits of a SimHash, too far for balls around
fingerprints, which propose the nearer ones. So the minima of BANDS times ROWS hash functions are taken over a text's shingles too,
and texts with ROWS equal minima in one band meet in a bucket: at similarity LEAST all but 4 in 10,000 pairs do.
Buckets of the same texts are kept once. Every bucket of two texts or more links its texts by
verified pairs: one after the other is held against all not yet linked, by postings of their shingles, so
that groups of very many near copies cost no more than their size. Nothing is capped.

A bucket whose shingles exceed BUCKET_BYTES is made smaller before it goes to a task: all its texts are held against one of them, the pivot, in a plain join, which can be
split and streams. What is near the pivot is linked by it. Jaccard distance is a metric, so such a text can only be near one that is not linked yet if its
distance from the pivot is at least that of the nearest of these less the greatest allowed; all others have nothing more to tell and leave the bucket, and so does the pivot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import majority, materialise
from ravelin.llm.components import components

SHINGLE = 5
#: Least similarity of near-duplicates, as a fraction, so that integers tell.
LEAST = (4, 5)
BANDS, ROWS = 20, 5
#: Bytes of the shingles of a bucket that goes to a task as it is, and the share of the bytes of larger ones that a round of pivots must take away for another one to follow.
BUCKET_BYTES, LEAST_GAIN = 8 << 20, 0.02
SEED = 42
ODD = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(SEED)
FACTORS, SUMS = _random.integers(1, 2**64, (2, BANDS * ROWS), np.uint64, endpoint=False)
FACTORS |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the n-shingles of the ASCII-lower-cased words, ascending; fewer words than n form one shingle, none give none."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: digest(w, SEED) for w in set(words)}
    own = np.fromiter((known[w] for w in words), np.uint64, len(words))
    length = min(n, len(own))
    total = np.full(len(own) - length + 1, length, np.uint64)
    for k in range(length):
        total = _mixed(total * ODD + own[k : len(own) - length + 1 + k])
    return np.unique(total)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(own), 4096):
        least = np.minimum(least, (own[a : a + 4096, None] * FACTORS + SUMS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * ODD + column)
    return key.view(np.int64)


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the pairs of similarity LEAST or more."""
    size = np.array([len(s) for s in sets])
    rest = np.ones(len(sets), bool)

    def postings() -> tuple[np.ndarray, np.ndarray, int]:
        some = np.flatnonzero(rest)
        flat, owner = np.concatenate([sets[k] for k in some]), np.repeat(some, size[some])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order], len(some)

    out: list[tuple[int, int]] = []
    hashes, owners, held = postings()
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first] = False
        queue = [first]
        while queue and (n := int(rest.sum())):
            if 2 * n <= held:
                hashes, owners, held = postings()
            at = queue.pop()
            start, stop = np.searchsorted(hashes, sets[at], "left"), np.searchsorted(hashes, sets[at], "right")
            n_hits = stop - start
            hits = owners[np.repeat(start - (np.cumsum(n_hits) - n_hits), n_hits) + np.arange(n_hits.sum())]
            both = np.bincount(hits, minlength=len(sets))
            found = np.flatnonzero(rest & (both * LEAST[1] >= (size + size[at] - both) * LEAST[0])).tolist()
            rest[found] = False
            out += [(at, x) for x in found]
            queue += found
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, hash of the words, SimHash and band keys of (uid, text)."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        content, fps, keys = [], [], []
        for text in batch.column("text").to_pylist():
            own = shingles(text)
            content.append(xxh64_intdigest(own.tobytes(), SEED))
            fps.append(majority(own))
            keys.append(band_keys(own) if len(own) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "content": pa.array(np.array(content, np.uint64).view(np.int64)), "fp": pa.array(fps, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))})


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"content": batch.column("content"), "shingles": pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())})


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of contents from rows (key, content, shingles) sorted by key."""
    key, held, contents = None, [], []

    def told() -> Iterator[pa.RecordBatch]:
        pairs = linked(held) if len(held) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_pydict({"a": [contents[x] for x, _ in pairs], "b": [contents[y] for _, y in pairs]})

    for batch in batches:
        for k, c, s in zip(*(batch.column(x).to_pylist() for x in ("key", "content", "shingles")), strict=True):
            if k != key:
                yield from told()
                key, held, contents = k, [], []
            held.append(np.frombuffer(s, np.uint64))
            contents.append(c)
    yield from told()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distance of each text from its bucket's pivot, and whether they are near-duplicates."""
    for batch in batches:
        far, close = [], []
        for own, pivot in zip(batch.column("shingles").to_pylist(), batch.column("pivot_shingles").to_pylist(), strict=True):
            x, y = np.frombuffer(own, np.uint64), np.frombuffer(pivot, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            far.append(1 - both / (len(x) + len(y) - both))
            close.append(both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0])
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "content", "fresh", "pivot")} | {"far": far, "close": pa.array(close, pa.bool_())})


def without_linked(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, content) of what buckets must still compare, and edges (a, b) found meanwhile. members: (key, content); sets: (content, shingles).

    Buckets of BUCKET_BYTES at most stay as they are. Larger ones go through rounds of pivots until they are small, or empty; if a round
    takes less than LEAST_GAIN of their bytes, they stay as large as they are, and whole.
    """
    size = F.octet_length("shingles").alias("bytes")
    members = materialise(members.join(sets.select("content", size), "content").withColumn("fresh", F.lit(True)), "sized")
    edges, done, before = [], [], None
    while True:
        large = materialise(members.groupBy("key").agg(F.sum("bytes").alias("all")).filter(F.col("all") > BUCKET_BYTES), "large")
        now = large.agg(F.sum("all")).first()[0] or 0
        if not now or (before is not None and now > (1 - LEAST_GAIN) * before):
            return reduce(DataFrame.union, [m.select("key", "content") for m in [*done, members]]), edges
        before = now
        done.append(members.join(large, "key", "left_anti"))
        rest = members.join(large.select("key"), "key")
        pivots = rest.filter("fresh").groupBy("key").agg(F.min("content").alias("pivot"))
        pivots = materialise(pivots.join(sets, F.col("pivot") == F.col("content")).select("key", "pivot", F.col("shingles").alias("pivot_shingles")), "pivots")
        rows = rest.join(sets, "content").join(pivots, "key").select("key", "content", "fresh", "shingles", "pivot", "pivot_shingles")
        held = materialise(rows.mapInArrow(_held, "key long, content long, fresh boolean, pivot long, far double, close boolean"), "held")
        edges.append(held.filter("close AND content <> pivot").select(F.col("pivot").alias("a"), F.col("content").alias("b")))
        nearest = held.filter("fresh AND NOT close").groupBy("key").agg(F.min("far").alias("nearest"))
        allowed = 1 - LEAST[0] / LEAST[1] + 1e-9
        kept = held.join(nearest, "key").filter((F.col("fresh") & ~F.col("close")) | ((F.col("content") != F.col("pivot")) & (F.col("far") >= F.col("nearest") - allowed)))
        members = materialise(kept.select("key", "content", (F.col("fresh") & ~F.col("close")).alias("fresh")).join(sets.select("content", size), "content"), "members")


def near_duplicates(docs: DataFrame, balls: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(uid, component_id) per row of docs (uid long, text), of rows in a group of near-duplicates: the least uid of the group.

    balls gives pairs (a, b) of near ones of SimHash fingerprints (fp, distinct); bands propose pairs in any case.
    Texts of the same shingles are near-duplicates, those without words too. Rows of a text that has no
    near-duplicate have their text's least uid. Repeated rows give repeated rows, an empty table none; long texts are read whole.
    """
    signed = materialise(docs.select("uid", "text").mapInArrow(_signed, "uid long, content long, fp long, bands array<long>"), "minhash")
    distinct = materialise(signed.groupBy("content").agg(F.min("uid").alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "contents")
    rows = distinct.select("content", F.explode("bands").alias("key"))
    if balls is not None:
        some = distinct.filter("size(bands) > 0").select("content", "fp")
        pairs = materialise(balls(some.select("fp").distinct()), "balls")
        of_pair = pairs.select(F.xxhash64("a", "b", F.lit("ball")).alias("key"), F.explode(F.array("a", "b")).alias("fp")).join(some, "fp").select("content", "key")
        rows = materialise(rows.union(of_pair).union(some.select("content", F.xxhash64("fp", F.lit("fingerprint")))), "keys")
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("content")).alias("x"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("y")).filter("n > 1")
    kept = materialise(many.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    members = materialise(rows.join(kept, "key"), "members")
    asked = members.select("content").distinct().join(distinct.select("content", "least"), "content")
    texts = docs.select("uid", "text").join(asked, F.col("uid") == F.col("least")).select("content", "text").mapInArrow(_shingled, "content long, shingles binary")
    sets = materialise(texts.groupBy("content").agg(F.min("shingles").alias("shingles")), "shingles")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, edges = without_linked(members, sets)
    buckets = left.join(sets, "content").select("key", "content", "shingles").repartition(parts, "key").sortWithinPartitions("key", "content")
    found = materialise(components(reduce(DataFrame.union, edges, buckets.mapInArrow(_edges, "a long, b long")).distinct()), "components")
    roots = materialise(found.join(distinct, found.node == distinct.content).groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    of_content = found.join(roots, "root").select(F.col("node").alias("linked"), "component_id")
    own = materialise(distinct.join(of_content, F.col("content") == F.col("linked"), "left").select("content", F.coalesce("component_id", "least").alias("component_id")), "components")
    return signed.join(own, "content").select("uid", "component_id")

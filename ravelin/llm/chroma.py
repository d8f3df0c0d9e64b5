"""Chroma audio fingerprints: pitch classes, integral-image filters, packed integers, and alignment by offsets.

A recording's spectrum is folded into twelve pitch classes a frame. Over the image of frames and classes
an integral image gives any rectangle's sum by four look-ups; sixteen filters compare rectangles within
WIDTH frames, and each answer is coded in two bits that differ by one between neighbours. So every
frame gives one 32-bit integer. Recordings of equal fingerprints form a class. The same half of two integers
REACH frames apart makes a key, so noise in one half leaves the other's. Each block of queries meets each block
of classes in one task, which looks up all keys of both; the histogram of the offsets between equal keys proposes
how two recordings align, and of all proposals with votes the share of differing bits over the alignment decides.
Silence has no keys.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table

RATE, FRAME, HOP = 4096, 1024, 256
LOWEST, HIGHEST = 180.0, 1900.0
WIDTH = 16
CLASSES = 12
#: Relative differences of rectangle sums that separate a filter's four answers.
STEPS = (-0.2, 0.0, 0.2)
GRAY = (0, 1, 3, 2)
#: Frames between the two integers of a key.
REACH = 12
#: Items of a block of recordings and of queries that one task aligns, recordings looked up at a time, and equal keys or items compared at a time.
BLOCK_ITEMS, QUERY_BLOCK_ITEMS, GROUP, PAIRS_AT_ONCE = 1 << 18, 1 << 20, 256, 1 << 20
#: Bits of an offset in a vote's code.
OFFSET_BITS = 26
#: An alignment needs so many equal keys at one offset, and at most this share of differing bits over at least so many
#: integers, some four seconds: shorter overlaps agree by chance.
LEAST_VOTES, MOST_ERROR, LEAST_OVERLAP = 2, 0.2, 60
#: Searches take the recordings whose id is divisible by this.
QUERY_STEP = 100


def filters() -> list[tuple[tuple[int, int, int, int], ...]]:
    """Sixteen pairs of lists of rectangles (frame, class, frames, classes): sum of the first against the second.

    For each of four bands of classes: earlier against later frames, lower against upper classes, the
    middle third of the frames against the outer ones, and the two diagonals of quarters.
    """
    out = []
    half, third = WIDTH // 2, WIDTH // 3
    for band in range(4):
        low, high = 3 * band, 3 * band + 6
        mid = low + 3
        out.append((((0, low, half, 6),), ((half, low, half, 6),)))
        out.append((((0, low, WIDTH, 3),), ((0, mid, WIDTH, high - mid),)))
        out.append((((third, low, WIDTH - 2 * third, 6),), ((0, low, third, 6), (WIDTH - third, low, third, 6))))
        out.append((((0, low, half, 3), (half, mid, half, 3)), ((half, low, half, 3), (0, mid, half, 3))))
    return out


@functools.lru_cache(4)
def _folding(rate: int, frame: int) -> np.ndarray:
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(hertz), CLASSES))
    some = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    out[some, np.round(12 * np.log2(hertz[some] / 440)).astype(int) % CLASSES] = 1
    return out


def pitch_classes(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, 12) energies by pitch class, each frame of length 1, or 0 if silent."""
    x = np.nan_to_num(np.asarray(samples, float), posinf=0.0, neginf=0.0)
    if len(x) < frame:
        return np.zeros((0, CLASSES))
    spectrum = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * np.hanning(frame), axis=1)) ** 2
    chroma = spectrum @ _folding(rate, frame)
    size = np.linalg.norm(chroma, axis=1, keepdims=True)
    return np.divide(chroma, size, out=np.zeros_like(chroma), where=size > 1e-9)


def pack(chroma: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each WIDTH consecutive frames."""
    n = len(chroma) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    wrapped = np.concatenate((chroma, chroma[:, : CLASSES // 2]), axis=1)  # the octave closes
    image = np.zeros((len(chroma) + 1, wrapped.shape[1] + 1))
    image[1:, 1:] = wrapped.cumsum(0).cumsum(1)
    total = lambda r: sum(image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y] for t, y, w, h in r)
    out = np.zeros(n, np.uint32)
    for k, (plus, minus) in enumerate(filters()):
        a, b = total(plus), total(minus)
        size = lambda r: sum(w * h for _, _, w, h in r)
        a, b = a / size(plus), b / size(minus)
        answer = np.searchsorted(STEPS, (a - b) / (a + b + 1e-9), "right")
        out |= np.array(GRAY, np.uint32)[answer] << np.uint32(2 * k)
    return out.view(np.int32)


#: What WIDTH silent frames give.
SILENCE = int(pack(np.zeros((WIDTH, CLASSES)))[0])


def half_keys(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): both halves of every two items REACH apart, the half's number in the lowest bit; none where both are silence's."""
    x = np.asarray(items, np.int32).view(np.uint32).astype(np.uint64)
    keys, places = [], []
    for shift in (0, 16):
        own = (x >> np.uint64(shift)) & np.uint64(0xFFFF)
        still = (np.uint32(SILENCE & 0xFFFFFFFF) >> np.uint32(shift)) & np.uint32(0xFFFF)
        a, b = own[:-REACH], own[REACH:]
        some = np.flatnonzero((a != still) | (b != still))
        keys.append(((a[some] << np.uint64(16) | b[some]) << np.uint64(1) | np.uint64(shift > 0)).astype(np.int64))
        places.append(some)
    return np.concatenate(keys), np.concatenate(places)


def _keys_of(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the list, place) of all keys of lists, by key."""
    got = [half_keys(x) for x in lists]
    key = np.concatenate([k for k, _ in got])
    order = np.argsort(key, kind="stable")
    return key[order], np.repeat(np.arange(len(got)), [len(k) for k, _ in got])[order], np.concatenate([p for _, p in got])[order]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _votes(index: tuple[np.ndarray, np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(number in index, number in asked, offset, votes) of equal keys, where votes are enough. The equal keys are counted a part at a time."""
    start, stop = np.searchsorted(index[0], asked[0], "left"), np.searchsorted(index[0], asked[0], "right")
    size = stop - start
    ends = np.cumsum(size)
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held, n = 0, int(ends[-1]) if len(ends) else 0
    for low in range(0, n, PAIRS_AT_ONCE):
        pair = np.arange(low, min(n, low + PAIRS_AT_ONCE))
        k = np.searchsorted(ends, pair, "right")
        at = start[k] + pair - (ends[k] - size[k])
        code = (index[1][at] * GROUP + asked[1][k] << OFFSET_BITS) + index[2][at] - asked[2][k] + (1 << OFFSET_BITS - 1)
        code, count = np.unique(code, return_counts=True)
        codes.append(code)
        counts.append(count)
        held += len(code)
        if held > 2 * PAIRS_AT_ONCE:
            code, count = _summed(codes, counts)
            codes, counts, held = [code], [count], 0
    code, count = _summed(codes, counts)
    code, count = code[count >= LEAST_VOTES], count[count >= LEAST_VOTES]
    pair = code >> OFFSET_BITS
    return pair // GROUP, pair % GROUP, (code & (1 << OFFSET_BITS) - 1) - (1 << OFFSET_BITS - 1), count


def _errors(a: list[np.ndarray], b: list[np.ndarray], of_a: np.ndarray, of_b: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of differing bits of a[i + offset] and b[i] where both exist, and how many those are, for each alignment of LEAST_OVERLAP or more."""
    flat_a, flat_b = np.concatenate(a).view(np.uint32), np.concatenate(b).view(np.uint32)
    n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    begin = np.maximum(0, -offset)
    n = np.maximum(0, np.minimum(n_b[of_b], n_a[of_a] - offset) - begin)
    at_a, at_b = (np.cumsum(n_a) - n_a)[of_a] + begin + offset, (np.cumsum(n_b) - n_b)[of_b] + begin
    share = np.ones(len(n))
    some = np.flatnonzero(n >= LEAST_OVERLAP)
    part = np.cumsum(n[some]) // PAIRS_AT_ONCE
    for own in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []:
        ends = np.cumsum(n[own])
        step = np.arange(ends[-1]) - np.repeat(ends - n[own], n[own])
        bits = np.bitwise_count(flat_a[np.repeat(at_a[own], n[own]) + step] ^ flat_b[np.repeat(at_b[own], n[own]) + step])
        share[own] = np.add.reduceat(bits, ends - n[own], dtype=np.int64) / (32 * n[own])
    return share, n


MATCH = pa.schema([(c, pa.int64()) for c in ("id", "class_id", "n_items", "offset", "votes")] + [("bit_error", pa.float64()), ("n_overlap", pa.int64())])


def _aligned(queries: pa.Table, classes: pa.Table) -> pa.Table:
    """Best alignments within the limits of a block of queries with a block of classes, both (id, items)."""
    if not queries.num_rows or not classes.num_rows:  # such a side has no columns
        return MATCH.empty_table()
    ids = queries.column("id").to_numpy(), classes.column("id").to_numpy()
    own, others = ([np.asarray(x, np.int32) for x in t.column("items").to_numpy()] for t in (queries, classes))
    out: list[list[np.ndarray]] = [[np.zeros(0, f.type.to_pandas_dtype()) for f in MATCH]]
    index = _keys_of(own)
    for low in range(0, len(others), GROUP):
        some = others[low : low + GROUP]
        q, c, offset, votes = _votes(index, _keys_of(some))
        error, n = _errors(own, some, q, c, offset)
        good = np.flatnonzero((error <= MOST_ERROR) & (n >= LEAST_OVERLAP) & (ids[0][q] != ids[1][low + c]))
        good = good[np.lexsort((offset[good], np.abs(offset[good]), -votes[good], c[good], q[good]))]
        first = good[np.flatnonzero(np.diff(q[good] * GROUP + c[good], prepend=-1))]
        out.append([ids[0][q[first]], ids[1][low + c[first]], np.array([len(own[k]) for k in q[first]], np.int64), offset[first], votes[first], np.round(error[first], 6), n[first]])
    return pa.Table.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out, strict=True), MATCH, strict=True)], schema=MATCH)


def rendered(values: list[float] | None) -> np.ndarray:
    """A melody of a vector: a note of three hops for each value, its pitch class by the value, its octave by the place."""
    if not values:
        return np.zeros(0)
    v = np.nan_to_num(np.asarray(values, float))
    tone = np.clip((v + 0.4) / 0.8, 0, 0.999) * 12 // 1
    hertz = 220 * 2 ** (tone / 12 + np.arange(len(v)) % 3)
    step = np.repeat(2 * np.pi * hertz / RATE, 3 * HOP)
    return np.sin(np.cumsum(step))


def fingerprints(rows: DataFrame, key: str, column: str, samples: Callable = np.asarray, rate: int = RATE) -> DataFrame:
    """(id, items array<int>) of rows; samples turns a value of column into audio at rate. Too short or null audio has no items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                got = [pack(pitch_classes(samples(v if v is not None else []), rate)) for v in part.column("audio").to_pylist()]
                items = pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)]).astype(np.int32), np.concatenate(got) if got else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "items": items})

    return rows.select(F.col(key).cast("long").alias("id"), F.col(column).alias("audio")).mapInArrow(run, "id long, items array<int>")


def search(prints: DataFrame, is_query) -> DataFrame:
    """Alignments of query recordings with all: two kinds of rows.

    member: id, class_id (least id of equal fingerprints), n_items, of every row of prints (id, items).
    match: id and class_id are class representatives, that of a query's class and of another class;
    offset, votes, bit_error and n_overlap tell the best alignment of the two. Classes without
    items match nothing. Of the offsets within the limits the best has most votes; of equal ones the one nearest 0, then the least.
    Rows of null items give none. A null id is a member like any other and no query; a class of null ids alone matches nothing. Rows that repeat an id are members each.
    Long recordings are compared whole. An empty table gives no rows; other columns are ignored.
    """
    prints = materialise(prints, "prints")
    classes = materialise(prints.groupBy("items").agg(F.min("id").alias("class_id"), F.max(F.when(is_query(F.col("id")), 1).otherwise(0)).alias("query")), "classes")
    members = prints.join(classes.select("items", "class_id"), "items").select(F.lit("member").alias("kind"), "id", "class_id", F.size("items").cast("long").alias("n_items"))
    some = classes.filter((F.size("items") > REACH) & F.col("class_id").isNotNull())
    n = some.agg(F.sum(F.size("items").cast("long")).alias("all"), F.sum(F.when(F.col("query") == 1, F.size("items").cast("long"))).alias("asked")).first()
    n_blocks, n_query_blocks = 1 + (n["all"] or 0) // BLOCK_ITEMS, 1 + (n.asked or 0) // QUERY_BLOCK_ITEMS
    # each side names its columns anew: with shared ones cogroup hands over wrong tables
    block = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    asked = some.filter("query = 1").select(block(n_query_blocks).alias("of_q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("of_c"), F.col("class_id").alias("id"), F.col("items").alias("items"))
    others = some.select(block(n_blocks).alias("of_c"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("of_q"), F.col("class_id").alias("id"), F.col("items").alias("items"))
    found = asked.groupBy("of_q", "of_c").cogroup(others.groupBy("of_q", "of_c")).applyInArrow(_aligned, "id long, class_id long, n_items long, offset long, votes long, bit_error double, n_overlap long")
    return members.unionByName(found.select(F.lit("match").alias("kind"), "*"), allowMissingColumns=True)


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of vectors holds no audio, so each vector is rendered as a melody; vectors that are alike sound alike."""
    rows = table(spark, sf_dir, "embeddings")
    return search(fingerprints(rows, "vec_id", "embedding", rendered), lambda i: i % QUERY_STEP == 0)

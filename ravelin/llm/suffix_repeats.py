"""Repeated passages of the whole corpus by enhanced suffix arrays.

Every string of LEAST = 100 bytes is dealt out by its minimizer, the least hash of its GRAM-byte grams:
equal strings have equal minimizers. Neighbouring strings mostly share theirs, so a text falls apart
into short pieces, one row each; a run of one character or pattern is cut every MOST_WINDOWS strings, so
its inner pieces are equal too. Pieces of one minimizer and equal bytes are copies: all but the first
are repeats as a whole, and only the first goes on. Every task tells copies among its own pieces before
the shuffle, so a passage that very many documents share gives a row a batch of them. Pieces of one
minimizer that differ, as at the edges
of a repeated passage, meet with their bytes. Over them a suffix array with common-prefix lengths is
scanned by a stack, which walks the tree of its common-prefix intervals: an interval of LEAST bytes or
more whose members have more than one left neighbour is a maximal repeat, with all its occurrences.
The occurrences other than the first are removed.

No suffix array covers more than ARRAY_BYTES, about 200 bytes of memory each. A minimizer whose different
pieces are more than GROUP_BYTES together, as next to a line that very many documents share, is split by the
place of the minimizer in the string: strings that hold it within some 17 places share LEAST - 16 bytes, whose
hash is their second key. So a piece falls into a few parts, not into a row for each string. Equal parts are told
by their bytes, different ones of one key meet in suffix arrays; keys that are still too frequent are split
again by 4 places and by one, which leaves single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table

LEAST = 100
GRAM = 32
#: Bytes of text that are hashed at a time, and windows of one piece at most.
CHUNK, MOST_WINDOWS = 1 << 20, 1 << 9
#: Bytes of pieces that one suffix array covers at most, and of the pieces of one minimizer that are not split.
ARRAY_BYTES, GROUP_BYTES = 1 << 20, 1 << 18
#: Ranges that the places of a minimizer in its strings are cut into, each time its pieces are split.
RANGES = 4
#: Pieces that a task holds to tell copies among them before they are shuffled.
HELD_PIECES = 1 << 19

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of each gram of size bytes, a power of two, by doubling."""
    x, n, k = _BYTE[data], 1, 0
    while n < size:
        x = x[:-n] * _ODD[k % 6] + x[n:]
        n, k = 2 * n, k + 1
    x ^= x >> np.uint64(29)
    x *= _ODD[7]
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    n = 1
    while 2 * n <= size:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (size - n)], x[size - n :]) if n < size else x


def pieces_of(data: np.ndarray, bounds: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of texts data[bounds[k]:bounds[k + 1]]: minimizer, first and last-plus-one window,
    and whether it holds its minimizer more than once, without which no string occurs twice in it."""
    n, gram = len(data) - least + 1, min(gram, 1 << (least.bit_length() - 2))
    if n <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2, np.empty(0, bool))
    grams, wide = gram_hashes(data, gram), least - gram + 1
    low = sliding_least(grams, wide)
    change = np.zeros(n + 1, np.int8)
    begin, end = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - least + 1)
    some = end > begin
    np.add.at(change, begin[some], 1)
    np.add.at(change, end[some], -1)
    valid = np.cumsum(change)[:n] > 0
    cut = ~valid
    cut[0] = True
    cut[1:] |= low[1:] != low[:-1]
    cut[begin[some]] = True
    at = np.flatnonzero(cut)
    until = np.append(at[1:], n)
    own = valid[at]
    at, until = at[own], until[own]
    if len(at) and (until - at).max() > MOST_WINDOWS:
        parts = [np.arange(a, b, MOST_WINDOWS) for a, b in zip(at, until, strict=True)]
        last = np.repeat(until, [len(p) for p in parts])
        at = np.concatenate(parts)
        until = np.minimum(at + MOST_WINDOWS, last)
    if not len(at):
        return low[at], at, until, np.empty(0, bool)
    # all places of grams that are some window's least, by hash and place
    padded = np.concatenate((np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)))
    places = np.flatnonzero(grams == ~sliding_least(~padded, wide))
    names, name = np.unique(grams[places], return_inverse=True)
    keys = np.sort(name * (len(data) + 1) + places)
    mine = np.searchsorted(names, low[at]) * (len(data) + 1)
    second = np.searchsorted(keys, mine + at) + 1
    more = np.append(keys, np.int64(2**62))[second] < mine + until + wide - 1
    return low[at], at, until, more


def _batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and the bounds of its values; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _chunks(bounds: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text plus one, from byte, to byte): CHUNK bytes of whole texts, or a part of a longer one."""
    k, n = 0, len(bounds) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(bounds, bounds[k] + CHUNK, "right")) - 1)
        j = min(j, n)
        if bounds[k + 1] - bounds[k] > CHUNK:
            for a in range(int(bounds[k]), int(bounds[k + 1]) - least + 1, CHUNK):
                yield k, k + 1, a, min(int(bounds[k + 1]), a + CHUNK + least - 1)
            k += 1
        else:
            yield k, j, int(bounds[k]), int(bounds[j])
            k = j


#: bytes is negative for pieces that hold their minimizer more than once; h of a copy only deals it out.
PIECE = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("bytes", pa.int32()), ("copy", pa.bool_())])
PIECE_SQL = "h long, c long, uid long, start long, bytes int, copy boolean"


def _later(group: np.ndarray, uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows that are not the first by (uid, start) of their group, and not alone in it."""
    order = np.argsort(group, kind="stable")
    same = group[order][1:] == group[order][:-1]
    some = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(same) else order[:0]
    some = some[np.lexsort((start[some], uid[some], group[some]))]
    return some[1:][group[some][1:] == group[some][:-1]]


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pieces of texts (uid, text). Those with an earlier piece of the same minimizer and content at hand are copies for certain."""
    from xxhash import xxh3_64_intdigest as digest

    held: list[list[np.ndarray]] = []

    def told() -> pa.RecordBatch:
        h, c, uid, start, size = (np.concatenate(x) for x in zip(*held, strict=True))
        copy = np.zeros(len(h), bool)
        copy[_later(h ^ c * _ODD[0], uid, start)] = True
        h = np.where(copy, uid.view(np.uint64) * _ODD[1] + start.view(np.uint64), h)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), uid, start, size, copy)], schema=PIECE)

    for batch in batches:
        uids = batch.column("uid").to_numpy()
        data, bounds = _batch_bytes(batch.column("text"))
        for k, j, a, b in _chunks(bounds, least):
            h, at, until, more = pieces_of(data[a:b], np.clip(bounds[k : j + 1], a, b) - a, least)
            if not len(h):
                continue
            view = memoryview(data[a:b])
            c = np.fromiter((digest(view[x : y + least - 1]) for x, y in zip(at.tolist(), until.tolist(), strict=True)), np.uint64, len(at))
            text = np.searchsorted(bounds[k : j + 1], at + a, "right") - 1 + k
            held.append([h, c, uids[text], at + a - bounds[text], (np.where(more, -1, 1) * (until - at + least - 1)).astype(np.int32)])
            if sum(len(x[0]) for x in held) > HELD_PIECES:
                yield told()
                held = []
    if held:
        yield told()


FOUND = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("bytes", pa.int32()), ("copy", pa.bool_())])
FOUND_SQL = "h long, uid long, start long, bytes int, copy boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces by (copy, h, c, uid, start): copies, and the first of each content where h has several, or where it may repeat itself."""
    last = None  # (h, c) of the last row
    held = None  # the last first-of-its-content, whether its h had another before, and whether it may repeat itself

    def batch_of(cols: list[np.ndarray], copy: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, np.full(len(cols[0]), copy))], schema=FOUND)

    for batch in batches:
        h, c, uid, start, size = (batch.column(n).to_numpy() for n in PIECE.names[:5])
        known = batch.column("copy").to_numpy(zero_copy_only=False)
        if known.any():
            yield batch_of([x[known] for x in (h, uid, start, np.abs(size))], True)
            h, c, uid, start, size = (x[~known] for x in (h, c, uid, start, size))
        if not len(h):
            continue
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first[0] = last is None or last != (h[0], c[0])
        last = (h[-1], c[-1])
        if (~first).any():
            yield batch_of([x[~first] for x in (h, uid, start, np.abs(size))], True)
        cols = [x[first] for x in (h, uid, start, np.abs(size))]
        alone = size[first] < 0
        before = np.zeros(len(cols[0]), bool)
        if held is not None:
            cols = [np.concatenate(([x], y)).astype(y.dtype) for x, y in zip(held[0], cols, strict=True)]
            before = np.concatenate(([held[1]], before))
            alone = np.concatenate(([held[2]], alone))
        if not len(cols[0]):
            continue
        same = cols[0][1:] == cols[0][:-1]
        before[1:] |= same
        needed = before | alone
        needed[:-1] |= same
        held = [x[-1] for x in cols], before[-1], alone[-1]
        needed[-1] = False  # told when the next is known
        if needed.any():
            yield batch_of([x[needed] for x in cols], False)
    if held is not None and (held[1] or held[2]):
        yield batch_of([np.array([x]).astype(t) for x, t in zip(held[0], (np.int64, np.int64, np.int64, np.int32), strict=True)], False)


class SuffixArray:
    """Suffixes of texts, joined with a least symbol between them, and their common-prefix lengths.

    at: positions by suffix; common[k]: length shared by at[k - 1] and at[k], never past a text's end;
    left: the symbol before a position, or minus the text's number minus one at a text's start.
    """

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + 1
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        data[begin + size] = 0
        self.begin, n = begin, len(data)
        self.text = np.repeat(np.arange(len(texts)), size + 1)
        self.rest = (begin + size)[self.text] - np.arange(n)
        rank, levels, k = data, [data], 1
        while k < size.max(initial=0):
            pair = rank.astype(np.int64) * (n + 300)
            pair[: n - k] += rank[k:] + 1
            distinct, rank = np.unique(pair, return_inverse=True)
            rank = rank.astype(np.int32)
            levels.append(rank)
            k *= 2
            if len(distinct) == n:
                break
        at = np.argsort(rank, kind="stable")
        self.at = at[self.rest[at] > 0]
        self.common = self._common(levels)
        self.left = np.where(self.at > begin[self.text[self.at]], data[np.maximum(self.at - 1, 0)], -1 - self.text[self.at])

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        p, q = self.at[:-1].copy(), self.at[1:].copy()
        most = np.minimum(self.rest[p], self.rest[q])
        got, n = np.zeros(len(p), np.int64), len(self.rest)
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            ok = np.flatnonzero(got + step <= most)
            x, y = p[ok] + got[ok], q[ok] + got[ok]
            ok = ok[levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]]
            got[ok] += step
        return np.concatenate(([0], got))

    def intervals(self, least: int) -> Iterator[tuple[int, int, int, list[int], bool]]:
        """Common-prefix intervals of at least `least`, inner ones first, by a stack over common:
        (length, first, last, cuts, diverse). cuts are the places in at where its parts begin;
        diverse tells whether its members have different left neighbours, as a maximal repeat has.
        """
        common, left = self.common.tolist(), self.left.tolist()
        inside = np.flatnonzero(self.common >= least)
        if not len(inside):
            return
        breaks = np.flatnonzero(np.diff(inside) > 1)
        for a, b in zip(inside[np.concatenate(([0], breaks + 1))].tolist(), inside[np.append(breaks, len(inside) - 1)].tolist(), strict=True):
            stack: list[list] = []  # length, first, cuts, left symbol that all share or None
            leaf, low = left[a - 1], a - 1
            for k in range(a, b + 2):
                now = common[k] if k <= b else least - 1
                first, shared = low, leaf
                while stack and stack[-1][0] > now:
                    length, first, cuts, own = stack.pop()
                    own = own if own == shared else None
                    yield length, first, k - 1, cuts, own is None
                    shared = own
                    if stack and stack[-1][0] >= now:
                        stack[-1][3] = stack[-1][3] if stack[-1][3] == shared else None
                        shared = stack[-1][3]
                if k > b:
                    break
                if stack and stack[-1][0] == now:
                    stack[-1][2].append(k)
                    stack[-1][3] = stack[-1][3] if stack[-1][3] == shared else None
                else:
                    stack.append([now, first, [first, k], shared])
                leaf, low = left[k], k


def repeats(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least `least` bytes in texts: length, and (text, start) of every occurrence."""
    array = SuffixArray(texts)
    for length, a, b, _, diverse in array.intervals(least):
        if diverse:
            at = array.at[a : b + 1]
            text = array.text[at]
            yield length, list(zip(text.tolist(), (at - array.begin[text]).tolist(), strict=True))


def later_occurrences(texts: list[bytes], places: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(text, start, length) of the occurrences of maximal repeats that are not their first one.

    places: (document, offset) of each text, which gives the order. An occurrence is told once, at its
    greatest length: of the parts of an interval, all but the one with the first occurrence tell theirs.
    """
    array = SuffixArray(texts)
    doc = np.fromiter((p[0] for p in places), np.int64, len(places))
    start = np.fromiter((p[1] for p in places), np.int64, len(places))
    text = array.text[array.at]
    order = np.lexsort((start[text] + array.at - array.begin[text], doc[text]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank.tolist()
    first: dict[int, int] = {}  # begin of a part -> its first occurrence
    out: list[tuple[int, int, int]] = []
    for length, _, _, cuts, diverse in array.intervals(least):
        heads = [first.pop(c, c) for c in cuts]
        best = min(heads, key=rank.__getitem__)
        if diverse:
            out += [(x, length) for x in heads if x != best]
        first[cuts[0]] = best
    at = array.at
    return [(int(t := array.text[at[x]]), int(at[x] - array.begin[t]), length) for x, length in out]


SPAN = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPAN_SQL = "uid long, start long, end long"


def _arrays(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Removed spans from pieces (h, uid, start, piece) by h, a suffix array over whole groups of h, of ARRAY_BYTES at most unless one is larger."""

    def spans(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        texts = [x[2] for x in group]
        texts, group = alike(texts, group, least)
        found = later_occurrences(texts, [(x[0], x[1]) for x in group], least) if len(texts) else []
        cols = [[group[t][0] for t, _, _ in found], [group[t][1] + s for t, s, _ in found], [group[t][1] + s + n for t, s, n in found]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=SPAN)

    now, group, size, last = [], [], 0, None  # pieces of the last h, of those before it, and their bytes
    for batch in batches:
        for h, uid, start, piece in zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "start", "piece")), strict=True):
            if h != last:
                group, now, last = group + now, [], h
            now.append((uid, start, piece))
            size += len(piece)
            if size > ARRAY_BYTES and group:
                yield spans(group)
                group, size = [], sum(len(x[2]) for x in now)
    if group or now:
        yield spans(group + now)


def alike(texts: list[bytes], rows: list, least: int) -> tuple[list[bytes], list]:
    """The texts that have a string of `least` bytes more than once, by hash: only they need sorting."""
    if not texts:
        return [], []
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(size)))
    h = window_hashes(data, least)
    text = np.repeat(np.arange(len(texts)), np.maximum(0, size - least + 1))
    at = np.concatenate([np.arange(a, b - least + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if len(text) else np.empty(0, np.int64)
    _, back, n = np.unique(h[at], return_inverse=True, return_counts=True)
    some = np.unique(text[n[back] > 1]).tolist()
    return [texts[k] for k in some], [rows[k] for k in some]


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every string of size bytes, of overlapping grams of powers of two."""
    n = 1 << (size.bit_length() - 1)
    x = gram_hashes(data, n)
    y = x[: len(x) - (size - n)] * _ODD[6] + x[size - n :]
    y ^= y >> np.uint64(31)
    return y * _ODD[5]


RANGE = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("bytes", pa.int32()), ("copy", pa.bool_()), ("piece", pa.binary())])
RANGE_SQL = "h long, uid long, start long, bytes int, copy boolean, piece binary"


def _ranges(batches: Iterator[pa.RecordBatch], least: int, width: int) -> Iterator[pa.RecordBatch]:
    """Pieces (uid, start, piece) cut by the place of the minimizer in their strings, in ranges of width places.

    h is the hash of what all strings of a range share. Parts with an earlier equal one at hand, by their bytes, are copies for certain and go without bytes.
    """
    for batch in batches:
        part: list[tuple[int, int, bytes]] = []
        size = 0
        for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "start", "piece")), strict=True):
            part.append(row)
            size += len(row[2])
            if size > ARRAY_BYTES:
                yield _ranges_of(part, least, width)
                part, size = [], 0
        if part:
            yield _ranges_of(part, least, width)


def _ranges_of(part: list[tuple[int, int, bytes]], least: int, width: int) -> pa.RecordBatch:
    raw = b"".join(x[2] for x in part)
    n = np.array([len(x[2]) - least + 1 for x in part])
    before = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat((least - 1) * np.arange(len(n)), n)
    owner = np.repeat(np.arange(len(n)), n)
    h, cut = cores(np.frombuffer(raw, np.uint8), at, least, width), np.ones(len(at), bool)
    if width > 1:  # strings one by one, else where what they share changes
        cut[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    of = owner[first]
    uid, start = np.array([x[0] for x in part], np.int64)[of], np.array([x[1] for x in part], np.int64)[of] + first - before[of]
    pieces: list[bytes | None] = [raw[a : b + least] for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)]
    size, copy, seen = np.fromiter(map(len, pieces), np.int32, len(pieces)), np.zeros(len(pieces), bool), set()
    for k in np.lexsort((start, uid)).tolist():
        if pieces[k] in seen:
            copy[k], pieces[k] = True, None
        else:
            seen.add(pieces[k])
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(uid), pa.array(start), pa.array(size), pa.array(copy), pa.array(pieces, pa.binary())], schema=RANGE)


def cores(data: np.ndarray, at: np.ndarray, least: int, width: int) -> np.ndarray:
    """Of each string of `least` bytes at `at`, the hash of the least - width + 1 bytes that it shares with the strings next to it
    that hold their minimizer in the same range of width places; what is hashed hangs on the string's bytes alone."""
    gram = min(GRAM, 1 << (least.bit_length() - 2))
    grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(data, gram), least - gram + 1)
    place = np.concatenate([grams[at[a : a + (1 << 14)]].argmin(axis=1) for a in range(0, len(at), 1 << 14)])  # the first, of equal ones
    return window_hashes(data, least - width + 1)[at + place % width]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their bytes from rows (uid, text, needed: h, start, bytes)."""
    schema = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.slice(a, 500)
            rows = [(x["h"], u, x["start"], raw[x["start"] : x["start"] + x["bytes"]]) for u, t, xs in zip(*(part.column(c).to_pylist() for c in ("uid", "text", "needed")), strict=True) for raw in [t.encode()] for x in xs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with uid, the order of documents, and whether no two rows share one.

    uid is doc_id where that is a key, else a number by doc_id, nulls last, and hash of the text.
    """
    own = docs.withColumn("uid", F.col("doc_id").cast("long"))
    if own.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1 or uid is null").isEmpty():
        return own, True
    own = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64("text"))
    distinct = own.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).distinct().orderBy(F.col("_i").asc_nulls_last(), "_h")
    number = materialise(distinct.withColumn("uid", F.monotonically_increasing_id()), "numbers")  # rises from one sorted partition to the next
    return own.join(number, own._id.eqNullSafe(number._i) & (own._hash == number._h)).drop("_id", "_hash", "_i", "_h"), False


def removed_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(uid, start, end) byte spans, overlapping ones among them, that cover just the bytes to remove from docs (uid, text).

    uid is a key and gives the order of documents.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("uid", "text").filter(F.octet_length("text") >= least)
    cut = texts.mapInArrow(lambda it: _cut(it, least), PIECE_SQL)
    found = materialise(cut.repartition(parts, "h").sortWithinPartitions("copy", "h", "c", "uid", "start").mapInArrow(_meet, FOUND_SQL), "pieces")
    copies = found.filter("copy").select("uid", "start", (F.col("start") + F.col("bytes")).alias("end"))
    firsts = found.filter("not copy").select("h", "uid", "start", "bytes")
    hot = materialise(firsts.groupBy("h").agg(F.sum("bytes").alias("n")).filter(F.col("n") > GROUP_BYTES).select("h"), "hot")
    some_hot = not hot.isEmpty()
    needed = firsts.groupBy("uid").agg(F.collect_list(F.struct("h", "start", "bytes")).alias("needed"))
    sliced = texts.join(needed, "uid").select("uid", "text", "needed").mapInArrow(_slices, "h long, uid long, start long, piece binary")
    if some_hot:
        sliced = materialise(sliced, "slices")
    usual = sliced.join(hot, "h", "left_anti") if some_hot else sliced
    spans = copies.union(usual.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(lambda it: _arrays(it, least), SPAN_SQL))
    wide = least - min(GRAM, 1 << (least.bit_length() - 2)) + 1  # places of a minimizer in its strings
    return spans.union(_split_spans(sliced.join(hot, "h", "left_semi").select("uid", "start", "piece"), least, wide)) if some_hot else spans


def _split_spans(split: DataFrame, least: int, places: int, level: int = 0) -> DataFrame:
    """Removed spans from pieces (uid, start, piece) of very frequent minimizers, whose strings hold theirs in so many places that are told apart in ranges.

    Parts of equal bytes are copies; different ones of one hash meet in suffix arrays, or are cut in finer ranges where there are too many, down to single strings.
    All counts have partial sums, and the joins stand alone, so very frequent parts can be split.
    """
    parts, width, suffix = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, places // RANGES), level or ""
    ranges = materialise(split.mapInArrow(lambda it: _ranges(it, least, width), RANGE_SQL), f"windows{suffix}")
    open_ones = ranges.filter("not copy")
    firsts = materialise(open_ones.groupBy("h", "piece").agg(F.min(F.struct("uid", "start")).alias("first"), F.count("*").alias("n")), f"firsts{suffix}")
    later = open_ones.join(firsts.filter("n > 1").select("h", "piece", "first"), ["h", "piece"]).filter((F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start")))
    spans = ranges.filter("copy").select("uid", "start", "bytes").union(later.select("uid", "start", "bytes")).select("uid", "start", (F.col("start") + F.col("bytes")).alias("end"))
    if width == 1:
        return spans
    different = firsts.select("h", "first.uid", "first.start", "piece")
    hot = materialise(different.groupBy("h").agg(F.sum(F.octet_length("piece")).alias("n")).filter(F.col("n") > GROUP_BYTES).select("h"), f"hot{level + 1}")
    some_hot = not hot.isEmpty()
    usual = different.join(hot, "h", "left_anti") if some_hot else different
    spans = spans.union(usual.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(lambda it: _arrays(it, least), SPAN_SQL))
    return spans.union(_split_spans(different.join(hot, "h", "left_semi").select("uid", "start", "piece"), least, width, level + 1)) if some_hot else spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join(out) + raw[at:]


def _with_spans(docs: DataFrame, least: int) -> DataFrame:
    own, key = numbered(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    spans = removed_spans(own if key else own.select("uid", "text").dropDuplicates(["uid"]), least).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    if not key:
        spans = materialise(spans, "spans")  # so that rows repeated very often can be split in the join
    return own.join(spans.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left").drop("_uid")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Digests per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `least` bytes over it also starts earlier: in a document of a smaller
    doc_id, or before in the same one. Null texts are empty; null ids come last. Rows that repeat both
    id and text are one document, each with its result; rows of one id and other texts are documents
    in the order of a hash of the text. Long texts are read whole. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_spans")), strict=True):
                raw, cut = text.encode(), merged(spans or [])
                rows.append((doc, len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept(raw, cut)).hexdigest()))
            cols = zip(*rows, strict=True) if rows else ([],) * 5
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), least)
    return own.select("doc_id", "text", "_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with repeated bytes taken out of text, and n_chars, if there, brought in line; all rows and columns stay.

    Bytes of a character that is cut through go as a whole. A null text becomes empty.
    """
    inner = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"c{k}" for k, c in enumerate(docs.columns)))
    names = inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept(t.encode(), merged(s)).decode("utf-8", "ignore") if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    out = _with_spans(inner, least).select(*names, "_spans").mapInArrow(run, inner.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(inner.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

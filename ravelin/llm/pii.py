"""Personal data by patterns, and terms that disclose it by their co-occurrence in the corpus.

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone numbers. The
WINDOW terms on either side of an entity's place form one window.
Over the whole corpus, a term t discloses an entity x as far as it tells x from chance:
log2 of p(x | t) / p(x), with p(x | t) the occurrences of t in windows of x over all occurrences of t, both with copies,
and p(x) the distinct windows of x over all terms. Where a pair has LEAST_WINDOWS distinct windows and LEAST_SHARE of t's
occurrences, or FEWEST_WINDOWS and that share by a smoothed estimate, and LEAST_BITS, t's places in windows of x are
spans too: they are generalised to a placeholder.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 4
LEAST_WINDOWS, LEAST_SHARE, LEAST_BITS = 3, 0.5, 8.0
#: Pairs of fewer windows than LEAST_WINDOWS, but this at least, disclose if the share holds with so many windows of other terms added.
FEWEST_WINDOWS, SMOOTHING = 2, 2
LEAST_LETTERS = 3
#: Distinct terms that a task counts before it passes the counts on.
COUNTED = 300_000

LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")  # from the start of a run of digits, so a long one is read once
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, in one pass: a local part is the run of its characters before @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = end = m.end()
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four numbers of a dotted run, as a leftmost search takes them; parts at most 255."""
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    twice = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(2 * d - 9 * (d > 4) for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, by start and then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(a, 1, b) for a, b in ips(text)]
        for m in CARD.finditer(text):
            if len(m[0]) >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def hashed(x: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(x.encode("utf-8", "replace"))
    return h - (h >> 63 << 64)


def windows(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms near each span that no span covers: term, start, end, entity, window (hash of its terms and entity)."""
    if not spans:
        return []
    out = []
    terms = list(TERM.finditer(text))
    starts, ends = [m.start() for m in terms], [m.end() for m in terms]
    for a, kind, b in spans:
        left, right = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        near = [m for m in terms[max(0, left - WINDOW) : left] + terms[right : right + WINDOW] if not any(x < m.end() and m.start() < y for x, _, y in spans)]
        entity = hashed(f"{kind}:{text[a:b].lower()}")
        window = hashed(f"{entity} " + " ".join(m[0].lower() for m in near))
        out += [{"term": hashed(m[0].lower()), "start": m.start(), "end": m.end(), "entity": entity, "window": window} for m in near if m.end() - m.start() >= LEAST_LETTERS]
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
NEAR = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.int64()), ("window", pa.int64())])
FOUND = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS[:4]]
    + [("base_sha256", pa.string()), ("base", pa.list_(SPAN)), ("near", pa.list_(NEAR)), ("term", pa.int64()), ("n", pa.int64())]
)
FOUND_SQL = (
    "row long, doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: int, kind: int, end: int>>,"
    " near array<struct<term: long, start: int, end: int, entity: long, window: long>>, term long, n long"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of term and n that count a part of all terms."""
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 40
    counts: Counter[str] = Counter()

    def told() -> Iterator[pa.RecordBatch]:
        terms = [t for t in counts if len(t) >= LEAST_LETTERS]
        cols = {f.name: pa.nulls(len(terms), f.type) for f in FOUND} | {"term": pa.array(map(hashed, terms), pa.int64()), "n": pa.array((counts[t] for t in terms), pa.int64())}
        yield from pa.table(cols, schema=FOUND).to_batches(20_000)
        counts.clear()

    for batch in batches:
        out: list[list] = [[] for _ in FOUND]
        for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
            text = text or ""
            spans = base_spans(text)
            counts.update(TERM.findall(text.lower()))
            n = Counter(k for _, k, _ in spans)
            values = (row, doc, h, n[0], n[1], n[2], n[3], hashlib.sha256(joined(spans).encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b in spans], windows(text, spans), None, None)
            for col, v in zip(out, values, strict=True):
                col.append(v)
            row += 1
            if len(counts) > COUNTED:
                yield from told()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND, strict=True)], schema=FOUND)
    yield from told()


def found(docs: DataFrame) -> DataFrame:
    """Entities, windows and term counts of docs (doc_id, text), written once: later steps read them twice."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return materialise(own.mapInArrow(_find, FOUND_SQL), "entities")


def disclosing(rows: DataFrame) -> DataFrame:
    """(term, entity, bits) of the pairs over the thresholds."""
    near = rows.filter("size(near) > 0").select(F.explode("near").alias("x")).select("x.term", "x.entity", "x.window").distinct()
    places = rows.filter("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.term", "x.entity", "x.start").distinct()
    together = places.groupBy("term", "entity").agg(F.count("*").alias("together"))
    pairs = near.groupBy("term", "entity").agg(F.count("*").alias("n_windows")).filter(F.col("n_windows") >= FEWEST_WINDOWS)
    pairs = materialise(pairs.join(together, ["term", "entity"]), "pairs")
    entities = near.groupBy("entity").agg(F.count_distinct("window").alias("of_entity"))
    counts = rows.filter("term is not null").select("term", "n")
    terms = counts.join(pairs.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("of_term"))
    total = counts.agg(F.sum("n").alias("total")).first().total or 1
    bits = F.log2(F.col("together") / F.col("of_term") / (F.col("of_entity") / F.lit(float(total))))
    both = pairs.join(terms, "term").join(entities, "entity")
    share = F.col("together") / F.col("of_term")
    enough = (F.col("n_windows") >= LEAST_WINDOWS) & (share >= LEAST_SHARE)
    smoothed = share * F.col("n_windows") / (F.col("n_windows") + SMOOTHING) >= LEAST_SHARE
    return both.filter(enough | smoothed).select("term", "entity", bits.alias("bits")).filter(F.col("bits") >= LEAST_BITS)


def added(rows: DataFrame) -> DataFrame:
    """(row, added) of the documents with disclosing terms."""
    near = rows.filter("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.*")
    hits = near.join(disclosing(rows), ["term", "entity"]).select("row", F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end").alias("span")).distinct()
    return hits.groupBy("row").agg(F.collect_list("span").alias("added"))


def all_spans(rows: DataFrame) -> DataFrame:
    """Rows of documents with spans: base and added ones, by start and kind."""
    more = added(rows).withColumnRenamed("row", "of_row")
    docs = rows.filter("row is not null")
    merged = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return docs.join(more, docs.row == more.of_row, "left").withColumn("spans", merged)


def text_of(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined; base
    ones of different kinds may overlap. Null and empty texts have none; long texts are read whole. Repeated rows give repeated
    rows and an empty table none; other columns are ignored.
    """
    return all_spans(found(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text_of(F.col("spans")).alias("spans"))


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans as the placeholder of its first."""
    out, at = [], 0
    end_of_run = -1
    for a, kind, b in spans:
        if a < end_of_run:
            end_of_run = max(end_of_run, b)
            at = end_of_run
            continue
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = end_of_run = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with all spans in text replaced by placeholders, and n_chars, if there, brought in line.

    All rows and columns stay, whatever the columns' names. Documents without spans keep their text as it is; a null text
    stays null and an empty one empty. Long texts are read whole. Of spans that overlap, the first's placeholder stands for
    all. Repeated rows are treated alike, each as often as it is there; an empty table stays empty.
    """
    own = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"c{k}" for k, c in enumerate(docs.columns)))
    names, schema = own.columns, own.schema
    rows = found(own)
    extra = materialise(added(rows), "disclosing")

    if extra.isEmpty():
        own = own.withColumn("_added", F.lit(None).cast("array<struct<start: int, kind: int, end: int>>"))
    else:
        of_row = extra.join(rows.filter("row is not null").select("row", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "row").dropDuplicates(["_doc", "_hash"])
        of_row = materialise(of_row.select("_doc", "_hash", F.col("added").alias("_added")), "added")  # alone in the join below, so that rows repeated very often can be split
        own = own.join(of_row, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & F.xxhash64("text").eqNullSafe(F.col("_hash")), "left").select(*names, "_added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("_added").to_pylist(), strict=True):
                spans = base_spans(text) if text else []
                if more:
                    spans = sorted(spans + [(x["start"], x["kind"], x["end"]) for x in more])
                texts.append(replaced(text, spans) if spans else text)
            cols = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = own.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out.toDF(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))

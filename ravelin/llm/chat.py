"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered by one template and encoded once; the spans of its turns and the
offsets of its tokens are both sorted, so binary search gives the tokens of each assistant text. Byte-level
tokens leave no gap in a text. A token that reaches over a span's edge counts for the part inside. Control strings inside texts get a
backslash after their first character, which is taken off when they are read back.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
#: What follows the first character of a control string: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
CONTROL = r"(?=\||/?s>|</?SYS>>|/?INST\])"
ESCAPE = re.compile(r"([<\[])(\\*)" + CONTROL)
UNESCAPE = re.compile(r"([<\[])\\(\\*)" + CONTROL)
TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)
LEARNED = "assistant"
COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TEXTS = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>"


class Formatted(NamedTuple):
    text: str
    ids: list[int]
    #: True for tokens with a character of an assistant text.
    mask: np.ndarray
    #: Rendered texts under the mask, a span for each assistant turn.
    spans: list[tuple[int, int]]


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation by the template, and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"<|{role.replace('%', '%25').replace('|', '%7C')}|>\n"
        body = escape(text)
        out += [head, body, "<|end|>\n"]
        at += len(head)
        if role == LEARNED:
            spans.append((at, at + len(body)))
        at += len(body) + len(out[-1])
    return "".join(out), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(m[1].replace("%7C", "|").replace("%25", "%"), unescape(m[2])) for m in TURN.finditer(text)]


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.post_processor = ByteLevel(trim_offsets=False)
    return own


def format_turns(turns: list[tuple[str, str]], path: str) -> Formatted:
    text, spans = render(turns)
    got = tokenizer(path).encode(text, add_special_tokens=False)
    offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
    starts, ends = offsets[:, 0], offsets[:, 1]
    mask, under = np.zeros(len(starts), bool), []
    for a, b in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if lo >= hi or a == b:
            under.append((a, a))
            continue
        mask[lo:hi] = True
        under.append((max(a, int(starts[lo])), min(b, int(ends[hi - 1]))))
    return Formatted(text, got.ids, mask, under)


def digest(conv_id: int | None, f: Formatted) -> tuple:
    """Values of COLUMNS, read back from the formatted conversation and its mask."""
    turns = read_back(f.text)
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "replace"))
    loss = "".join(unescape(f.text[a:b]) for a, b in f.spans)
    return conv_id, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(f.text)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Consecutive rows of one conv_id as its turns; a row without one is alone."""
    now, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and (conv != now or conv is None):
                yield now, turns
                turns = []
            now = conv
            turns.append((role or "", text or ""))
    if turns:
        yield now, turns


def format_conversations(rows: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """Formats rows (conv_id, turn, role, text): digests per conversation, or with texts the formatted
    text, its ids and a mask that is true for tokens under the loss.

    Rows of a conversation go by turn, nulls last, then role and text, so repeated rows are kept side
    by side. Null roles and texts are empty; each row without conv_id is a conversation of its own, as nothing tells what it
    belongs to. An empty table gives no rows; other columns are ignored. One conversation is one formatted text, long texts
    are encoded whole, and so is one task's work; rows are dealt out by conv_id, those without by what they say.
    """
    batch = 2000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))]) if texts else pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in COLUMNS.split(", "))])
        out: list[tuple] = []
        for conv, turns in _conversations(batches):
            f = format_turns(turns, path)
            out.append((conv, f.text, f.ids, f.mask.tolist()) if texts else digest(conv, f))
            if len(out) >= (100 if texts else batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = own.repartition(parts, F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, TEXTS if texts else COLUMNS)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return format_conversations(rows, public_tokenizers.path(VOCABULARY))

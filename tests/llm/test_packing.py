import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ravelin.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def ids(own, text):
    return [*own.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def whole(rows, own, texts, sequence):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, rs in by_doc.items():
        want, at = ids(own, texts[doc]), 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return padding


TEXTS = {
    1: "Hello, it's a Test of 123 words…", 2: None, 3: "", 4: " \n\t ", 5: "ΟΔΟΣ straße İstanbul ŉ ﬁ é é", 6: "<|endoftext|> x </w>",
    7: "word " * 3000, 8: "Ünï çödé ¿qué? " * 50, 9: "x" * 5000, 10: "日本語 テキスト 한국어 🙂", 11: "a\x1cb\x85c d e",
}


def test_whole_texts(spark, own):
    rows = [(k, v, "clash", 1) for k, v in TEXTS.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int").coalesce(1)
    got = packing.pack_documents(df, PATH, sequence=256, block=4).collect()
    assert whole(got, own, TEXTS, 256) == 0


def test_ids_are_the_pieces(spark, own):
    df = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df, PATH, with_ids=True).collect()
    assert {(r.doc_id, r.start): r.ids for r in got if r.doc_id == 2} and all(len(r.ids) == r.length for r in got)
    assert sum((r.ids for r in sorted(got, key=lambda r: r.start) if r.doc_id == 1), []) == ids(own, "one two")


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    assert sum(r.length for r in packing.pack_documents(df, PATH).collect()) == 6


@given(st.lists(st.text(st.characters(max_codepoint=0x250), max_size=30), max_size=3), st.sampled_from(["", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "|>"]))
def test_ids_are_the_tokenizers(own, texts, between):
    coder, text = packing.tokens(PATH), between.join(texts)
    assert coder.encode([text])[0] == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.text(st.sampled_from("aZ é\u0301\nÅ İſ日.9"), max_size=200))
def test_long_texts_in_parts(own, text):
    coder, part = packing.tokens(PATH), packing.PART
    try:
        packing.PART = 5
        assert "".join(packing.parts_of(text)) == text
        assert coder.encode([text, None, text])[2] == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    finally:
        packing.PART = part


@given(st.lists(st.integers(0, 300), max_size=40))
def test_pack_fills_exactly(lengths):
    total = sum(lengths)
    rooms = [64] * (total // 64) + packing.powers(total % 64)
    done = packing.pack(lengths, rooms)
    assert sum(p[2] for p in done) == total
    for d, n in enumerate(lengths):
        mine = sorted((p[1], p[2]) for p in done if p[0] == d)
        assert sum(m for _, m in mine) == n and all(a + m == b for (a, m), (b, _) in zip(mine, mine[1:], strict=False))


def test_costs_are_balanced():
    lengths = [40] * 10 + [5] * 80
    done = packing.pack(lengths, [100] * 8)
    spent = defaultdict(float)
    for d, s, n, k, _ in done:
        spent[k] += packing.cost(n)
    assert max(spent.values()) - min(spent.values()) <= packing.cost(40)


def test_sf(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert whole(packing.op1_packing(spark, "/root/testdata/sf0.001").collect(), own, texts, 4096) == 0

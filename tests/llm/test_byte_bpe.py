import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import byte_bpe

PATH = P.path(byte_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def want(own, text):
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [None, "", " ", "Hello  world!\n\n  it's", "<|endoftext|>", "ünïcödé 日本語 🙂‍", "x" * 5000, "ab" * 3000, "\x00\x01", "naïve antidisestablishmentarianism " * 40]


def test_round_trip(spark, own):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.round_trip(df, PATH, P.PATTERN).collect()}
    assert got == {k: want(own, t) for k, t in enumerate(TEXTS)}
    assert byte_bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
    assert byte_bpe.round_trip(df.union(df), PATH, P.PATTERN).count() == 2 * len(TEXTS)


@given(st.text(max_size=40))
@settings(deadline=None, max_examples=60)
def test_any_text(own, text):
    assert byte_bpe.codec(PATH, P.PATTERN).encode(text) == own.encode_ordinary(text)


@given(st.text(st.sampled_from("aZéž09 \n\t'st!²¼ªº_×.\u00a0\u3000"), max_size=40))
def test_plain_split(text):
    codec = byte_bpe.codec(PATH, P.PATTERN)
    assert codec.split(text) == codec.pattern.findall(text) and P.PATTERN == byte_bpe.PUBLIC_PATTERN


@given(st.lists(st.text(st.sampled_from("abehilnorst-=é"), min_size=1, max_size=60), max_size=3), st.integers(1, 30))
@settings(deadline=None, max_examples=60)
def test_long_words(own, words, times):
    codec, most = byte_bpe.codec(PATH, P.PATTERN), byte_bpe.LONG
    text = " ".join(w * times for w in words)
    try:
        byte_bpe.LONG = 1
        codec.known = {}
        assert codec.encode(text) == own.encode_ordinary(text)
    finally:
        byte_bpe.LONG = most


def test_every_token_is_what_its_bytes_contract_to():
    codec = byte_bpe.codec(PATH, P.PATTERN)
    for token in sorted(codec.ranks, key=codec.ranks.get)[::50]:
        ids = [codec.ranks[token[i : i + 1]] for i in range(len(token))]
        while found := [(codec.merges[x * 65536 + y], i) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if x * 65536 + y in codec.merges]:
            rank, i = min(found)
            ids[i : i + 2] = [rank]
        assert ids == [codec.ranks[token]]


def test_sf(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: want(own, r.text) for r in docs}

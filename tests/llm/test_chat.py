import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import chat

PATH = public_tokenizers.path(chat.VOCABULARY)
PARTS = st.lists(st.sampled_from(["<|", "|>", "end", "<|end|>\n", "\\", "</s>", "[INST]", "[/INST]", "<", "<<SYS>>", "\n", "é", "🙂", "日本", " ", "a b"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "end", "a|b%", ""]), PARTS), min_size=1, max_size=6))
@settings(deadline=None)
def test_round_trip_and_mask(turns):
    f = chat.format_turns(turns, PATH)
    assert chat.read_back(f.text) == turns
    assert [chat.unescape(f.text[a:b]) for a, b in f.spans] == [t for r, t in turns if r == "assistant"]
    assert len(f.ids) == len(f.mask)


def test_mask_tokens(spark):
    f = chat.format_turns([("user", "hello there"), ("assistant", "fine, thanks"), ("assistant", "")], PATH)
    got = chat.tokenizer(PATH).decode([i for i, m in zip(f.ids, f.mask, strict=True) if m])
    assert "fine, thanks" in got and "hello" not in got


ROWS = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, "user", None), (3, 0, None, "x"), (3, None, "assistant", "last"), (4, 0, "assistant", "y"), (4, 0, "assistant", "y"), (5, 0, "assistant", "w " * 20000), (None, 0, "user", "z")]


def brute(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.format_conversations(df, PATH).collect()}
    by = {}
    for c, t, r, x in sorted(ROWS, key=lambda x: (x[0] or 0, x[1] is None, x[1] or 0)):
        by.setdefault(c, []).append((r or "", x or ""))
    assert got == {c: brute(t) for c, t in by.items()}
    assert chat.format_conversations(df.limit(0), PATH).count() == 0
    full = chat.format_conversations(df, PATH, texts=True).collect()
    assert all(len(r.ids) == len(r.loss_mask) for r in full) and len(full) == len(by)


def test_sf(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    by[-1] = [("user", said), ("assistant", said)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.op9_chat(spark, "/root/testdata/sf0.001").collect()} == {c: brute(t) for c, t in by.items()}

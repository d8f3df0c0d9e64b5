import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import calc, jsonrepair, numeric, text


def one(spark, value, kind, *columns):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*[c(F.col("x")) for c in columns]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_sentences(spark):
    assert one(spark, "  One. Two!\nThree?  four\r ", "string", text.split_sentences) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, " \n ", "string", text.split_sentences) == []
    assert one(spark, ["How?", " a ", "", "Why?", "b."], "array<string>", text.question_last) == ["How?", "a", "b.", "Why?"]
    assert one(spark, ["How?", "b."], "array<string>", text.question_last) == ["b.", "How?"]
    assert one(spark, ["a", "b?"], "array<string>", text.question_last) == ["a", "b?"]
    assert one(spark, [], "array<string>", text.question_last) == []


@pytest.mark.parametrize("v, want", [(None, "base"), ("", "base"), ("LX", "TB"), ("HN1", "PED"), ("HN2", "HU"), ("LEX", "SP"), ("base", "base"), ("other", "other")])
def test_variants(spark, v, want):
    assert one(spark, v, "string", text.canonical_variant) == want


def test_variant_lists(spark):
    assert one(spark, ["LX", "HN1", "TB", "base", None, "HN2"], "array<string>", text.canonical_variants) == ["TB", "PED", "base", "HU"]
    assert one(spark, None, "array<string>", text.canonical_variants) is None


@pytest.mark.parametrize("w, want", [("Berries", "berry"), ("glasses", "glass"), ("boxes", "box"), ("pens", "pen"), ("grass", "grass"), ("ox", "ox")])
def test_lemma(spark, w, want):
    assert one(spark, w, "string", text.lemma) == want


def test_schema_functions(spark):
    q = "Each crate has 6 bottles. He buys 12 pens per day. 3 times each shelf contains 20 booklets."
    assert one(spark, q, "string", text.units) == ["bottle", "booklet", "pen", "shelf"] or "pen" in one(spark, q, "string", text.units)
    assert one(spark, q, "string", text.forbidden_pairs) == ["bottle per crate", "booklet per shelf"]
    c = one(spark, "a <<14/2=7>> b <<x=3>> c <<14+7=21>>\n#### 21 \n", "string", text.calc_chain)
    assert list(c.exprs) == ["14/2", "14+7"] and c.final == "21"
    assert one(spark, "<<6*3=18>>18", "string", text.calc_chain).final == "18"
    assert one(spark, "plain", "string", text.calc_chain).final is None
    assert one(spark, "x #### 1\n#### 2,000", "string", text.final_answer) == "2,000" and one(spark, None, "string", text.final_answer) == ""
    assert one(spark, "Ava saw The 12 cats, 4.5 and 12", "string", text.core_words, text.core_numbers) == (["Ava"], ["12", "4.5"])


def test_evidence(spark):
    s = ["He has 3 pens.", "Birds sing.", "Find the rest", "Half are red.", "How many?"]
    pick = lambda m, e=None: one(spark, s, "array<string>", lambda c: text.pick_evidence(c, m, F.array(*map(F.lit, e)) if e else F.array().cast("array<string>")))
    assert pick("heuristic") == [0, 3] and pick("all") == [0, 1, 2, 3, 4] and pick("mse", ["3*2"]) == [0] and pick("mse", ["9*9"]) == [0, 3]
    assert one(spark, ["a", "b?"], "array<string>", lambda c: text.pick_evidence(c, "heuristic")) == [0]
    with pytest.raises(ValueError):
        text.pick_evidence(F.col("x"), "none")
    assert one(spark, [5, 2, None, 2, -1, 0], "array<int>", lambda c: text.clean_evidence(c, F.lit(4))) == [0, 2]
    assert one(spark, None, "array<int>", lambda c: text.clean_evidence(c, F.lit(2))) == [0]


NUMBER = re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?")


@pytest.mark.parametrize("t", ["1,234.5 and 6", "none", "", "-.5e3x", "1d", "+7", "1e999", None, "  42 "])
def test_to_number(spark, t):
    m = NUMBER.search((t or "").strip().replace(",", ""))
    want = float(m[0]) if m and abs(float(m[0])) != float("inf") else None
    assert one(spark, t, "string", numeric.to_number) == want


def test_answers(spark):
    eq = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(numeric.answers_equal(F.col("a"), F.col("b"))).first()[0]
    assert eq("18", "18.0 apples") and eq("Yes ", "y ES") and not eq("18", "19") and not eq("a", None) and eq(None, "none")


def test_evidence_scores(spark):
    rows = [([1, 2], [2, 3]), ([], []), ([1], []), ([], [1]), ([2, 1, 2], [1, 2])]
    df = spark.createDataFrame(rows, "p array<int>, g array<int>").select(numeric.evidence_scores(F.col("p"), F.col("g")).alias("s")).collect()
    assert [tuple(r.s) for r in df] == [(0.5, 0.5, 0.5, False), (1.0, 1.0, 1.0, True), (0.0, 1.0, 0.0, False), (0.0, 0.0, 0.0, False), (1.0, 1.0, 1.0, True)]


@given(st.text(max_size=30), st.integers(2, 100))
def test_md5_mod_formula(t, k):
    import hashlib

    h = hashlib.md5(t.encode()).hexdigest()
    hi, lo = int(h[:16], 16), int(h[16:], 16)
    assert ((hi % k) * (2**64 % k) + lo % k) % k == int(h, 16) % k


def test_hashes(spark):
    import hashlib

    for t in ("abc", "", "ü"):
        for k in (5, 64, 97):
            assert one(spark, t, "string", lambda c, k=k: numeric.md5_mod(c, k)) == int(hashlib.md5(t.encode()).hexdigest(), 16) % k
    assert one(spark, "abc", "string", lambda c: numeric.problem_seed(c, 42)) == 42 + int(hashlib.md5(b"abc").hexdigest()[:8], 16)


@pytest.mark.parametrize("steps, want", [
    (["x = 3 * 4", "x + 1.0"], "13"), (["2 ** 10"], "1024"), (["sqrt(16) + max(1, 2)"], "6"), (["7 / 2"], "3.5"), ("5 - 7", "-2"), ([], "Error: calc_steps must be a non-empty list"),
    (["  "], "Error: no steps evaluated"), (["sum([1, 2, 3])"], "6"), (["-(-3) % 2"], "1"), (["1e3 + 1"], "1001"), (["round(2.5)"], "2"),
])
def test_calculator(steps, want):
    assert calc.calculate(steps) == want


@pytest.mark.parametrize("step", ["__import__('os')", "open('x')", "x + 1", "1 / 0", "9 ** 9 ** 9", "[].append(1)", "(lambda: 1)()", "1 if 1 else 2", "'a' * 3", "2 ** 100000", "True + 1", "f(1)", "1 +", "-" * 200 + "1"])
def test_calculator_refuses(step):
    assert calc.calculate([step]).startswith("Error")


def test_calculator_state(spark):
    state = {}
    assert calc.calculate(["a = 2"], state) == "2" and calc.calculate(["a * 5"], state) == "10"
    assert one(spark, ["a = 2", "a ** 3"], "array<string>", calc.calculate_steps) == "8"
    chain = lambda e, f: spark.sql("select 1").select(calc.recomputed(F.struct(F.array(*map(F.lit, e)).alias("exprs"), F.lit(f).alias("final")))).first()[0]
    assert chain(["2+3"], None) == "5.0" and chain(["1/0"], None) is None and chain(["1"], "9") == "9"


@pytest.mark.parametrize("t, want", [
    ('{"a": 1}', {"a": 1}), ("<think>x</think> ```json\n{'a': True, 'b': [1, 2,],}\n```", {"a": True, "b": [1, 2]}), ('so {"a": {"b": 2}} end', {"a": {"b": 2}}),
    ("The answer is 42 apples", {"final_answer": "42", "_parse_fallback": True}), ("x = 7", {"final_answer": "7", "_parse_fallback": True}), ("3 or 4.5", {"final_answer": "4.5", "_parse_fallback": True}),
])
def test_json(spark, t, want):
    assert jsonrepair.read_object(t) == want
    assert jsonrepair.read_strict(t) == ({} if "_parse_fallback" in want else want)


def test_json_none(spark):
    with pytest.raises(ValueError):
        jsonrepair.read_object("nothing here")
    assert one(spark, "nothing", "string", jsonrepair.object_text) is None and one(spark, "{'a': 1}", "string", jsonrepair.object_text) == '{"a": 1}'
    assert jsonrepair.llama_tool_calls('[{"name": "f", "parameters": "{\\"x\\": 1}"}, 3, {"function": "g", "arguments": {}}]') == [("f", {"x": 1}), ("g", {})]


def test_free_text(spark):
    assert one(spark, "a <answer> 12 </answer> <b>", "string", text.tagged_answer) == "12" and one(spark, "x <7> <reasoning> <9>", "string", text.tagged_answer) == "9"
    assert one(spark, '{"pred_answer": "5", "evidence_ids": [1, 2', "string", lambda c: text.recovered_fields(c)).pred_evidence_ids == [1, 2]
    assert one(spark, " 1 + 2\t", "string", text.normal_expression) == "1+2" and one(spark, "1/2 ; final=3; ;2", "string", text.chain_steps) == ["1/2", "2"]
    assert one(spark, "a<think>b\nc</think> d ", "string", text.without_think_tags) == "a d"
    assert one(spark, "v {a} {b}", "string", lambda c: text.fill_template(c, a=F.lit(1), b=F.lit(None))) == "v 1 "


def plain_tokenizer():
    """Stands for a tokenizer with a template of its own."""

    class Plain:
        def apply_chat_template(self, messages, tokenize, add_generation_prompt, enable_thinking):
            assert tokenize is False
            turns = "".join(f"<{m['role']}>{m['content']}</{m['role']}>" for m in messages)
            return turns + ("<assistant>" if add_generation_prompt else "") + ("<think>" if enable_thinking else "")

    return Plain()


def test_chat_prompt(spark):
    from ravelin.functions.chat import chat_prompt

    df = spark.createDataFrame([(1, "How many?"), (2, ""), (3, None)], "k int, text string")
    got = df.orderBy("k").select(chat_prompt(F.col("text"), plain_tokenizer).alias("a"), chat_prompt(F.col("text"), plain_tokenizer, add_generation_prompt=False, enable_thinking=True).alias("b")).collect()
    assert [r.a for r in got] == ["<user>How many?</user><assistant>", "<user></user><assistant>", None]
    assert [r.b for r in got] == ["<user>How many?</user><think>", "<user></user><think>", None]
    with pytest.raises(ValueError, match="unknown chat template"):
        chat_prompt(F.col("text"), plain_tokenizer, template="other")

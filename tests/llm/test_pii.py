import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from ravelin.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule, text or "") if fits(kind, m[0])]
    return sorted(out)


@given(st.lists(st.sampled_from(["a", "Z.", "@", "x@y.z", ".", "-", "1", "255", "256.", "1.2.3.4", "+", "+49 170 1234567", "4111 1111 1111 1111", " ", "(0)", "é", "0" * 5]), max_size=20).map("".join))
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


TEXTS = [None, "", "no data", "mail a.b@c.de, ip 10.0.0.1 and 4111-1111-1111-1111, +1 (555) 123-4567", "x@y.z" * 3, "1" * 3000, "a" * 30000 + "@", "é ü x@example.org"]


def test_base_rows(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for r in pii.find_personal_data(df).collect():
        want = brute(TEXTS[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest() and r.spans == pii.joined(want)
    assert pii.find_personal_data(df.limit(0)).count() == 0
    assert pii.find_personal_data(df.union(df)).count() == 2 * len(TEXTS)


def secret_corpus():
    texts = [f"note {i % 7} about things {chr(97 + i)} Zarquon keeps x{0}@mail.example {chr(98 + i)} here" for i in range(6)]
    return [t.replace("x0", "zark") for t in texts] + ["common words about things here keeps note"] * 600


def test_disclosing_terms(spark):
    texts = secret_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for k in range(6):
        a = texts[k].index("Zarquon")
        assert f"term:{a}:{a + 7}" in got[k].split(",") and "term" not in got[k].replace(f"term:{a}:{a + 7}", "")
    assert all(not got[k] for k in range(6, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("Zarquon" not in clean[k] and "<EMAIL>" in clean[k] and "<TERM>" in clean[k] for k in range(6))
    assert all(clean[k] == texts[k] for k in range(6, len(texts)))


def test_copies_disclose_nothing(spark):
    df = spark.createDataFrame([(k, "unique Zarquon words x@mail.example follow") for k in range(50)], "doc_id long, text string")
    assert all("term" not in r.spans for r in pii.find_personal_data(df).collect())


def test_sanitise_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_chars long")
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == 2 * len(TEXTS)
    for r in out.collect():
        assert not pii.base_spans(r.text or "") and (r.n_chars == len(r.text) if r.text is not None else r.n_chars == 0)


def test_sf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in docs}
    for r in pii.op10_pii(spark, "/root/testdata/sf0.001").collect():
        assert r.base_sha256 == hashlib.sha256(pii.joined(brute(texts[r.doc_id])).encode()).hexdigest()


def test_long_runs_are_read_once():
    import time

    began = time.process_time()
    assert pii.base_spans("1" * 300000) == [] and pii.base_spans("a" * 300000 + "@") == [] and pii.base_spans("1." * 100000)[0] == (0, 1, 7)
    assert time.process_time() - began < 5


def test_copies_hide_no_term(spark):
    texts = secret_corpus() * 3 + [f"a lone {w} Quillon met quill@mail.example {w} once" for w in ("red", "blue")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for k, name in [(k, "Zarquon") for k in range(len(texts) - 2) if "Zarquon" in texts[k]] + [(k, "Quillon") for k in (len(texts) - 2, len(texts) - 1)]:
        a = texts[k].index(name)
        assert f"term:{a}:{a + 7}" in got[k].split(",")


def test_nearest_terms_at_any_distance():
    text = "far Zarquon " + "1 | " * 200 + "x@mail.example " + "- " * 200 + "beyond"
    got = pii.windows(text, pii.base_spans(text))
    assert [text[x["start"] : x["end"]] for x in got] == ["far", "Zarquon", "beyond"]


def by_counting(texts):
    """Term spans by plain counts: pairs of a term and an entity that meet in windows of four terms on either side."""
    term, total, places, windows = re.compile(r"[^\W\d_]+"), Counter(), {}, {}
    of_term, of_entity, near = Counter(), {}, []
    for k, text in enumerate(texts):
        spans, terms = brute(text), [m.span() for m in term.finditer(text)]
        of_term.update(w for w in term.findall(text.lower()) if len(w) >= 3)
        for a, kind, b in spans:
            entity = (kind, text[a:b].lower())
            some = [t for t in terms if t[1] <= a][-4:] + [t for t in terms if t[0] >= b][:4]
            some = [t for t in some if all(t[1] <= x or t[0] >= y for x, _, y in spans)]
            window = (entity, tuple(text[x:y].lower() for x, y in some))
            for x, y in some:
                if y - x >= 3:
                    pair = text[x:y].lower(), entity
                    places.setdefault(pair, set()).add((k, x))
                    windows.setdefault(pair, set()).add(window)
                    of_entity.setdefault(entity, set()).add(window)
                    near.append((k, x, y, pair))
    total = sum(of_term.values())
    told = set()
    for pair, at in places.items():
        share, n = len(at) / of_term[pair[0]], len(windows[pair])
        if (n >= 3 and share >= 0.5 or n >= 2 and share * n / (n + 2) >= 0.5) and math.log2(share / (len(of_entity[pair[1]]) / total)) >= 8:
            told.add(pair)
    return {(k, x, y) for k, x, y, pair in near if pair in told}


def test_disclosing_terms_by_counting(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    names = [(word().title() + "son", f"{word()}x@mail.example") for _ in range(25)]
    texts = []
    for _ in range(1500):
        parts = [word() for _ in range(r.randint(3, 25))]
        if r.random() < 0.15:
            name, mail = r.choice(names)
            parts[r.randint(0, len(parts) - 1)] += f" {name} {word()} {mail}"
        if r.random() < 0.05:
            parts.append(r.choice(names)[0])
        texts.append(" ".join(parts))
    texts += texts[:200]
    want = by_counting(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, *map(int, x.split(":")[1:])) for r in pii.find_personal_data(df).collect() for x in r.spans.split(",") if x.startswith("term")}
    assert got == want and len(want) > 30

"""SQL of the training-data operators that SQL can express, as DuckDB runs it.

Nothing here shares code with the operators: repeats are found by comparing all strings of 100 bytes, XXH64 is computed by wide
integers, components are a closure over all pairs, and conversations are digested without being formatted.
"""

from __future__ import annotations

REPEATS = """
WITH docs AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT doc_id, base, substr(h, 2 * base + 1, 2 * (128 + 99)) AS block FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 128)) AS base FROM docs)
), windows AS (
    SELECT doc_id, base + i AS start, substr(block, 2 * i + 1, 200) AS w FROM (SELECT doc_id, base, block, unnest(range(least(128, length(block) // 2 - 99))) AS i FROM blocks)
), later AS (
    SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, start) > 1
), runs AS (
    SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run
    FROM (SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS fresh FROM later)
), spans AS (
    SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM runs GROUP BY doc_id, run
), cuts AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h,
           sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
    FROM cuts JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

#: Fixed values of XXH64: two to the 64th, and its primes.
M = "18446744073709551616::UHUGEINT"
P1, P2, P3, P4, P5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def times(x, p, plus="0::UHUGEINT"):
    """x times p plus plus, modulo two to the 64th."""
    return f"((({x})::UHUGEINT * {p} + {plus}) % {M})"


def turned(x, r):
    """x turned left by r bits: modulo all ones two to the 64th is one (x of all ones, one in two to the 64th, would give 0)."""
    return f"((({x})::UHUGEINT * {1 << r}::UHUGEINT) % 18446744073709551615::UHUGEINT)"


def lane(v, k):
    return times(turned(f"({v} + {times(k, P2)}) % {M}", 31), P1)


def little(at, size):
    """The number in size bytes from byte at of the hex string x, lowest byte first."""
    return "('0x' || " + " || ".join(f"substr(x, ({at}) * 2 + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def lanes(j, start):
    """Lane j after all stripes of 32 bytes."""
    return f"list_reduce(list_transform(range(n // 32), lambda i: {little(f'32 * i + {8 * j}', 8)}), lambda v, k: {lane('v', 'k')}, ({start}) % {M})"


#: Hash of the four lanes together.
merged = f"({' + '.join(turned(f'v{j}', r) for j, r in enumerate((1, 7, 12, 18)))}) % {M}"
for j in range(4):
    merged = times(f"xor({merged}, {lane('0::UHUGEINT', f'v{j}')})", P1, P4)
SIMHASH = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
    SELECT doc_id, array_to_string(words[i:i + 2], ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), coded AS (
    SELECT gram, hex(encode(gram)) AS x, octet_length(encode(gram))::BIGINT AS n FROM (SELECT DISTINCT gram FROM grams)
), laned AS MATERIALIZED (
    SELECT gram, {lanes(0, f"42::UHUGEINT + {P1} + {P2}")} AS v0, {lanes(1, f"42::UHUGEINT + {P2}")} AS v1, {lanes(2, "42::UHUGEINT")} AS v2, {lanes(3, f"42::UHUGEINT + {M} - {P1}")} AS v3
    FROM coded WHERE n >= 32
), started AS MATERIALIZED (
    SELECT c.gram, x, n, ((CASE WHEN n < 32 THEN 42::UHUGEINT + {P5} ELSE {merged} END) + n::UHUGEINT) % {M} AS h FROM coded c LEFT JOIN laned USING (gram)
), eights AS MATERIALIZED (
    SELECT gram, x, n, list_reduce(list_transform(range(n % 32 // 8), lambda i: {little("n // 32 * 32 + 8 * i", 8)}), lambda h, k: {times(turned(f"xor(h, {lane('0::UHUGEINT', 'k')})", 27), P1, P4)}, h) AS h
    FROM started
), fours AS MATERIALIZED (
    SELECT gram, x, n, CASE WHEN n % 8 >= 4 THEN {times(turned(f"xor(h, {times(little('n // 8 * 8', 4), P1)})", 23), P2, P3)} ELSE h END AS h FROM eights
), ones AS MATERIALIZED (
    SELECT gram, list_reduce(list_transform(range(n % 4), lambda i: {little("n // 4 * 4 + i", 1)}), lambda h, k: {times(turned(f"xor(h, {times('k', P5)})", 11), P1)}, h) AS h FROM fours
), mixed1 AS MATERIALIZED (
    SELECT gram, {times("xor(h, h >> 33::UHUGEINT)", P2)} AS h FROM ones
), mixed2 AS MATERIALIZED (
    SELECT gram, {times("xor(h, h >> 29::UHUGEINT)", P3)} AS h FROM mixed1
), hashed AS MATERIALIZED (
    SELECT gram, xor(h, h >> 32::UHUGEINT)::UBIGINT AS h FROM mixed2
), bits AS (
    SELECT doc_id, b, 2 * count(*) FILTER ((h >> b::UBIGINT) & 1::UBIGINT = 1) > count(*) AS bit
    FROM grams JOIN hashed USING (gram), (SELECT unnest(range(64)) AS b) GROUP BY doc_id, b
), prints AS MATERIALIZED (
    SELECT t.doc_id, coalesce(sum(1::UBIGINT << b::UBIGINT) FILTER (bit), 0)::UBIGINT AS fp FROM texts t LEFT JOIN bits USING (doc_id) GROUP BY t.doc_id
), distinct_prints AS MATERIALIZED (
    SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp
), links AS MATERIALIZED (
    SELECT a.fp AS a, b.fp AS b FROM distinct_prints a JOIN distinct_prints b ON bit_count(xor(a.fp, b.fp)) <= 3
), reach AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
    SELECT a AS fp, min(least) AS component_id FROM reach JOIN distinct_prints ON b = fp GROUP BY a
)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN roots USING (fp)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, role IS NOT NULL AS r, text IS NOT NULL AS x
    FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, r, role, x, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, r, role, x, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length('<||>' || chr(10) || '<|end|>' || chr(10)) + length(replace(replace(role, '%', '%25'), '|', '%7C'))
               + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|</?SYS>>|/?INST\])')))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id, alone
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

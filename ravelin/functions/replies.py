"""Answers, evidence and reasoning out of one model reply, where a partition has to decide at once whether to ask again."""

from __future__ import annotations

import re

from ravelin.functions.jsonrepair import read_object, read_strict

# Elements that hold an answer, and the numbers of a reasoning.
ANSWER_ELEMENT = re.compile(r"(?is)<\s*(?:answer|result|final_answer)\s*>\s*([^<>]+?)\s*<\s*/\s*(?:answer|result|final_answer)\s*>")
ANGLED = re.compile(r"<([^>]+)>")
ELEMENT_NAME = re.compile(r"/?[A-Za-z_][\w:-]*")
WHOLE_NUMBER = re.compile(r"\b(\d+(?:\.\d+)?)\b")
SIGNED = re.compile(r"-?\d+(?:\.\d+)?")
NOT_OUTPUTS = ("Error", "[CALCULATOR")


def angled_answer(text: str, most: int) -> str:
    """What an answer element holds, else the last <...> that is no element's name; nothing longer than most."""
    if (m := ANSWER_ELEMENT.search(text)) and len(m[1]) <= most:
        return m[1]
    found = [m.strip() for m in ANGLED.findall(text) if len(m) <= most]
    return next((x for x in reversed(found) if not ELEMENT_NAME.fullmatch(x)), "")


def lenient_field(text: str, key: str, most: int) -> str:
    """A field's value in broken JSON: up to the closing quote, or to the line's end, a comma or a brace where there is none."""
    m = re.search(rf"""(?i)["']?{key}["']?\s*[:=]\s*""", text)
    rest = text[m.end() :] if m else ""
    quote = rest[:1] if rest[:1] in ("'", '"') else ""
    whole, closed, _ = rest[len(quote) :].partition(quote) if quote else ("", "", "")
    return (whole if closed else re.split(r"[,}\n]", rest[len(quote) :], maxsplit=1)[0]).strip().strip("\"'")[:most]


def lenient_ids(text: str) -> list[int]:
    m = re.search(r"""(?i)["']?evidence_ids["']?\s*[:=]\s*\[([^\]]{0,2000})""", text)
    return [int(x) for x in re.findall(r"-?\d+", m[1])] if m else []


def ids_of(found: dict) -> list[int]:
    ids = found.get("evidence_ids")
    return [int(x) for x in ids if isinstance(x, (int, float))] if isinstance(ids, list) else []


def text_of(found: dict, key: str) -> str:
    return str(found.get(key, "")).strip()


def object_of(text: str, lenient: bool) -> dict:
    """The reply's object. Lenient reading takes no number for an object, and fills what is missing from broken JSON."""
    if not lenient:
        try:
            found = read_object(text)
        except ValueError as e:
            return {"reasoning": f"JSON parse error: {e}"}
        return found if isinstance(found, dict) else {}
    found = read_strict(text)
    if not ids_of(found):
        found["evidence_ids"] = lenient_ids(text)
    if not text_of(found, "final_answer"):
        found["final_answer"] = re.sub(r"</?[^>]+>", "", lenient_field(text, "final_answer", 120) or angled_answer(text, 60)).strip()
    if not text_of(found, "reasoning"):
        found["reasoning"] = lenient_field(text, "reasoning", 4000) or lenient_field(text, "calc_chain", 4000) or text
    return found


def last_number(text: str) -> str:
    """The last unsigned number of a text, a whole one without its point; empty if there is none."""
    found = WHOLE_NUMBER.findall(text)
    return "" if not found else str(int(float(found[-1]))) if float(found[-1]).is_integer() else found[-1]


def usable_output(trace: list[dict]) -> str:
    """The last call's output, unless it is an error or the calculator's notice."""
    output = str(trace[-1]["output"]) if trace else ""
    return "" if output.startswith(NOT_OUTPUTS) else output


def after_tools(text: str, trace: list[dict], tool_mode: str, lenient: bool) -> dict:
    """Fields of a reply that ends a tool loop; without an answer the last output stands in."""
    found = object_of(text, lenient)
    reasoning = str(found.get("reasoning", ""))
    answer = text_of(found, "final_answer") or (angled_answer(reasoning, 30) if lenient else "")
    if not answer and tool_mode != "noop":
        answer = usable_output(trace)
    written = " | ".join(" ; ".join(map(str, t["input"])) for t in trace)
    return {"pred_answer": answer, "pred_evidence_ids": ids_of(found), "reasoning": reasoning, "expression": written}


def without_tools(text: str, lenient: bool) -> dict:
    """Fields of a reply to the tool prompt without tools; without an answer the reasoning's last number stands in, unless read leniently."""
    found = object_of(text, lenient)
    reasoning = str(found.get("reasoning", ""))
    numbers = SIGNED.findall(reasoning)
    answer = text_of(found, "final_answer") or (angled_answer(reasoning, 30) if lenient else numbers[-1] if numbers else "")
    return {"pred_answer": answer, "pred_evidence_ids": ids_of(found), "reasoning": reasoning, "expression": ""}


def chain_of_thought(text: str, lenient: bool) -> dict:
    """Fields of a worked answer: final_answer, else the chain's <...>; one that the chain does not hold gives way to the chain's last number, unless read leniently."""
    try:
        found = read_strict(text) if lenient else read_object(text)
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    chain = str(found.get("calc_chain") or text)
    answer = text_of(found, "final_answer") or angled_answer(chain, 30)
    if lenient:
        answer = answer or lenient_field(text, r"final[_\s]?answer", 120)
    elif answer and answer not in chain:
        answer = last_number(chain) or answer
    return {"pred_answer": answer, "pred_evidence_ids": ids_of(found) or (lenient_ids(text) if lenient else []), "reasoning": chain, "expression": ""}

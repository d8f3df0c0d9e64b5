"""Reading JSON objects out of model replies: think tags, fences, broken quoting, a bare number at last."""

from __future__ import annotations

import ast
import json
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.text import xml_tool_calls  # noqa: F401  the column form of K5

# What counts as an answer in free text, the kinds that come first before the others.
ANSWERS = re.compile(r"(?:final.?answer|answer|result|total)\s*(?:is|=|:)\s*(?P<named>\d+(?:\.\d+)?)|=\s*(?P<equals>\d+(?:\.\d+)?)\s*$|(?<![.\w])(?P<free>\d+(?:\.\d+)?)(?![.\w])", re.I | re.M)
THINK = re.compile(r"<think>.*?</think>", re.S)
FENCE = re.compile(r"```(?:json)?\s*")
FALLBACK = "_parse_fallback"


def number_fallback(text: str) -> dict | None:
    """The first named answer, else the first number behind an equals sign at a line's end, else the last number that stands alone."""
    kinds: dict[str, list[str]] = {"named": [], "equals": [], "free": []}
    for m in ANSWERS.finditer(text):
        kinds[m.lastgroup].append(m[m.lastgroup])
    best = kinds["named"][:1] or kinds["equals"][:1] or kinds["free"][-1:]
    return {"final_answer": best[0], FALLBACK: True} if best else None


def _literals_to_json(text: str) -> str:
    """Python names, trailing commas and single quotes outside double-quoted strings turned to JSON."""
    out = []
    for part in re.split(r'("(?:[^"\\]|\\.)*")', text):
        if not part.startswith('"'):
            part = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1].replace("\\'", "'")), part)
            part = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", part)))
        out.append(part)
    return re.sub(r",\s*([}\]])", r"\1", "".join(out))


def repaired(text: str) -> str:
    try:
        return json.dumps(ast.literal_eval(text), ensure_ascii=False)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return _literals_to_json(text)


def _first_object(text: str) -> str | None:
    """From the first { to its match, braces counted wherever they stand; the brace alone if it has none."""
    braces = [m for m in re.finditer(r"[{}]", text[text.find("{") :])] if "{" in text else []
    if not braces:
        return None
    inner = text[text.find("{") :]
    depth = accumulate(1 if m[0] == "{" else -1 for m in braces)
    return inner[: next((m.end() for m, d in zip(braces, depth, strict=True) if d == 0), 1)]


def read_object(text: str | None):
    """The JSON value of a reply; a number fallback is flagged. ValueError if nothing can be read."""
    clean = FENCE.sub("", THINK.sub("", text or "").strip()).strip()
    try:
        return json.loads(clean)
    except ValueError:
        pass
    inner = _first_object(clean)
    for attempt in () if inner is None else (inner, repaired(inner)):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    found = number_fallback(clean)
    if found is None:
        raise ValueError(f"no JSON in {clean[:200]!r}")
    return found


def read_strict(text: str | None) -> dict:
    """The object, or {} where it cannot be read or is only a number fallback."""
    try:
        found = read_object(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) and not found.get(FALLBACK) else {}


def llama_tool_calls(text: str | None) -> list[tuple[str, dict]]:
    """(name, arguments) of an object or list of objects with name or function, and arguments or parameters."""
    try:
        found = json.loads((text or "").strip())
    except ValueError:
        return []
    out = []
    for call in found if isinstance(found, list) else [found]:
        if not isinstance(call, dict):
            continue
        name = call.get("name") or call.get("function")
        name = name.get("name") if isinstance(name, dict) else name
        given = call.get("arguments", call.get("parameters", {}))
        if isinstance(given, str):
            try:
                given = json.loads(given)
            except ValueError:
                given = {}
        if isinstance(name, str) and name:
            out.append((name, given if isinstance(given, dict) else {}))
    return out


@F.pandas_udf(T.StringType())
def _object_text(text: pd.Series) -> pd.Series:
    def read(t: str | None) -> str | None:
        try:
            return json.dumps(read_object(t), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(read)


def object_text(text: Column) -> Column:
    """The reply's object as JSON text, or null: from_json reads on from there. Only replies that are no JSON as they stand go to Python."""
    plain = ~F.contains(text, F.lit("<think>")) & ~F.contains(text, F.lit("```")) & F.try_parse_json(text).isNotNull()
    return F.when(plain, text).otherwise(_object_text(F.when(~F.coalesce(plain, F.lit(False)), text)))

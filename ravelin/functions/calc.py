"""A calculator for steps such as `x = 3 * 4`: an interpreter of whitelisted syntax, never eval.

Steps that differ in their numbers alone have one shape. A shape is parsed once a worker and worked out over columns of numbers, a column for each
number of the shape; rows whose shape cannot be worked out so, or fails for one of them, go to the interpreter one by one, which tells what is wrong.
"""

from __future__ import annotations

import ast
import functools
import math
import operator
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions that steps may call.
FUNCTIONS = {"abs": abs, "round": round, "min": min, "max": max, "int": int, "float": float, "pow": pow, "sum": sum, "sqrt": math.sqrt, "ceil": math.ceil, "floor": math.floor}
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
NAME = re.compile(r"[a-zA-Z_]\w*")
ASSIGNMENT = re.compile(r"([a-zA-Z_]\w*)\s*=(?!=)\s*(.+)", re.S)
MOST_BITS, MOST_EXPONENT, MOST_DEPTH = 4096, 1024, 60
#: A number that may be taken out of a step, and a name that stands for the k-th one.
NUMBER, PLACE = re.compile(r"(?<![\w.])(?:0|[1-9]\d*)(?:\.\d+)?(?![\w.])"), "_number_{}_"
#: Parsed shapes that a worker keeps.
MOST_SHAPES = 10_000
# What the calculator says of steps that it does not take.
NO_LIST, NO_RESULT, BAD_NAME, FAILED = "Error: calc_steps must be a non-empty list", "Error: no steps evaluated", "Error: disallowed name in step '{}'", "Error in step '{}': {}"


class Refused(ValueError):
    """The expression is outside what the calculator takes."""


def _power(a, b):
    if abs(b) > MOST_EXPONENT or (isinstance(a, int) and isinstance(b, int) and a.bit_length() * abs(b) > MOST_BITS):
        raise Refused("power is too large")
    return a**b


def _bounded(value):
    if isinstance(value, int) and value.bit_length() > MOST_BITS:
        raise Refused("number is too large")
    return value


def work_out(node: ast.AST, names: dict, apply: Callable, depth: int = 0):
    """Value of a parsed expression; apply calls a function on the values of its arguments, rows or columns of them."""
    if depth > MOST_DEPTH:
        raise Refused("expression is too deep")
    go = lambda x: work_out(x, names, apply, depth + 1)
    match node:
        case ast.Expression(body=body):
            return go(body)
        case ast.Constant(value=bool()):
            raise Refused("only numbers are taken")
        case ast.Constant(value=int() | float() as value):
            return value
        case ast.Name(id=name) if name in names:
            return names[name]
        case ast.UnaryOp(op=op, operand=x) if type(op) in UNARY:
            return apply(UNARY[type(op)], go(x))
        case ast.BinOp(left=a, op=ast.Pow(), right=b):
            return apply(_power, go(a), go(b))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
            return apply(lambda x, y, f=BINARY[type(op)]: _bounded(f(x, y)), go(a), go(b))
        case ast.List(elts=xs) | ast.Tuple(elts=xs):
            return apply(lambda *values: list(values), *map(go, xs))
        case ast.Call(func=ast.Name(id="pow"), args=[a, b], keywords=[]):
            return apply(_power, go(a), go(b))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return apply(FUNCTIONS[name], *map(go, args))
        case _:
            raise Refused(f"{type(node).__name__} is not taken")


@functools.lru_cache(MOST_SHAPES)
def tree(expression: str) -> ast.Expression:
    return ast.parse(expression, mode="eval")


def evaluate(expression: str, names: dict | None = None):
    """Value of an arithmetic expression over numbers, names and the whitelisted functions."""
    return work_out(ast.parse(expression.strip(), mode="eval"), names or {}, lambda f, *values: f(*values))


def shown(value) -> int | float:
    """A whole float as an int."""
    return int(value) if isinstance(value, float) and math.isfinite(value) and value == int(value) else value


class Step(NamedTuple):
    """A step as it was written, the variable that it sets, if any, its expression, and the names in that."""

    text: str
    sets: str | None
    expression: str
    uses: frozenset

    @classmethod
    def of(cls, text: str) -> Step:
        m = ASSIGNMENT.fullmatch(text)
        expression = m[2] if m else text
        return cls(text, m[1] if m else None, expression, frozenset(NAME.findall(re.sub(r"\d+(?:\.\d*)?[eE][-+]?\d+", "0", expression))) - FUNCTIONS.keys())


def steps_of(steps: Iterable) -> list[Step]:
    return [Step.of(s) for s in (str(s).strip() for s in steps) if s]


def calculate(steps, state: dict | None = None) -> str:
    """Result of the last step as text; any error gives a text that starts with Error. state keeps variables between calls."""
    steps = [steps] if isinstance(steps, str) else steps
    if not (steps and isinstance(steps, list)):
        return NO_LIST
    names, result = {k: v for k, v in (state or {}).items() if NAME.fullmatch(str(k))}, None
    for step in steps_of(steps):
        if not step.uses <= names.keys():
            return BAD_NAME.format(step.text)
        try:
            result = shown(evaluate(step.expression, names))
        except Exception as e:  # the contract is a text, whatever a step does
            return FAILED.format(step.text, e)
        if step.sets:
            names[step.sets] = result
            if state is not None:
                state[step.sets] = result
    return NO_RESULT if result is None else str(result)


def shape_of(steps: list) -> tuple[tuple[str, ...], list[str]]:
    """Steps with their numbers taken out, and the numbers."""
    numbers: list[str] = []

    def place(m: re.Match) -> str:
        numbers.append(m[0])
        return PLACE.format(len(numbers) - 1)

    return tuple(NUMBER.sub(place, str(s)) for s in steps), numbers


def column(values: Iterable) -> np.ndarray:
    """Python numbers as they are, so that whole ones stay exact."""
    out = np.empty(len(values := list(values)), object)
    out[:] = values
    return out


def calculate_shape(shape: tuple[str, ...], numbers: list[list[str]]) -> np.ndarray | None:
    """Results, as numbers, of all rows of a shape, each with its numbers; None where the interpreter has to tell row by row."""
    rows = len(numbers)
    names = {PLACE.format(k): column(float(x) if "." in x else int(x) for x in own) for k, own in enumerate(zip(*numbers, strict=True))}
    full = lambda x: x if isinstance(x, np.ndarray) else column([x] * rows)
    apply = lambda f, *values: np.frompyfunc(f, len(values), 1)(*map(full, values)) if values else f()
    result = None
    try:
        for step in steps_of(shape):
            if not step.uses <= names.keys():
                return None
            result = apply(shown, work_out(tree(step.expression.strip()), names, apply))
            if step.sets:
                names[step.sets] = result
    except Exception:  # of one row at least
        return None
    return result


def calculate_all(rows: list[list | None]) -> list[str]:
    """calculate() of many rows, shape by shape."""
    out = ["" if r else NO_LIST for r in rows]
    by_shape: dict[tuple, list[tuple[int, list[str]]]] = {}
    for k, steps in enumerate(rows):
        if steps:
            shape, numbers = shape_of(steps)
            by_shape.setdefault(shape, []).append((k, numbers))
    for shape, own in by_shape.items():
        found = calculate_shape(shape, [n for _, n in own])
        for i, (k, _) in enumerate(own):
            out[k] = calculate(rows[k]) if found is None else str(found[i])
    return out


@F.pandas_udf(T.StringType())
def _calculate(steps: pd.Series) -> pd.Series:
    return pd.Series(calculate_all([None if s is None else list(s) for s in steps]))


def calculate_steps(steps: Column) -> Column:
    """calculate() over an array of steps in each row."""
    return _calculate(steps)


@F.pandas_udf(T.DoubleType())
def _chain_value(expressions: pd.Series) -> pd.Series:
    def value(xs) -> float | None:
        try:
            out = None
            for x in [] if xs is None else xs:
                if not re.fullmatch(r"[0-9+\-*/().\s]+", x):
                    return None
                out = evaluate(x)
            return None if out is None else float(out)
        except Exception:  # division by zero and the like: no value
            return None

    return expressions.map(value)


def recomputed(chain: Column) -> Column:
    """final of a calculation chain if it has one, else the value of its last expression; null on an arithmetic error."""
    return F.coalesce(F.when(chain.final != "", chain.final), _chain_value(chain.exprs).cast("string"))

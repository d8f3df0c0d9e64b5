"""Which of many phrase lists a text holds, by one pass of an Aho-Corasick automaton over it.

The plan has one function, however many phrases there are: a worker builds the automaton of all lists once and keeps it.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Automata that a worker keeps.
MOST_KEPT = 8


@functools.lru_cache(MOST_KEPT)
def automaton(lists: tuple[tuple[str, ...], ...]) -> ahocorasick.Automaton:
    """Each phrase, lower-cased, with a bit for every list that has it."""
    found = ahocorasick.Automaton()
    for k, phrases in enumerate(lists):
        for p in phrases:
            low = p.lower()
            if low:
                found.add_word(low, found.get(low, 0) | 1 << k)
    if len(found):
        found.make_automaton()
    return found


def masks(texts: list[str | None], lists: tuple[tuple[str, ...], ...]) -> list[int]:
    """A bit for every list of which a text, lower-cased already, holds a phrase; lists with an empty phrase are in every text."""
    known, every = automaton(lists), sum(1 << k for k, phrases in enumerate(lists) if "" in phrases)
    full, out = (1 << len(lists)) - 1, []
    for t in texts:
        mask = every
        if t and len(known):
            for _, bits in known.iter(t):
                mask |= bits
                if mask == full:
                    break
        out.append(mask)
    return out


def held(text: Column, lists: dict[str, list[str]]) -> Column:
    """A struct of a boolean for each list by name: whether text holds any of its phrases, in any case. Null for a null text."""
    names, phrases = list(lists), tuple(tuple(p) for p in lists.values())

    @F.arrow_udf(", ".join(f"`{n}` boolean" for n in names))
    def run(texts: pa.Array) -> pa.Array:
        found = masks(pc.utf8_lower(texts).to_pylist(), phrases)
        valid = texts.is_valid()
        none = pa.scalar(None, pa.bool_())
        return pa.StructArray.from_arrays([pc.if_else(valid, pa.array([m >> k & 1 == 1 for m in found], pa.bool_()), none) for k in range(len(names))], names)

    return run(text)

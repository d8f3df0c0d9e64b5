"""Table functions: noise of a variant for each problem, called from SQL with a table as argument or by a lateral join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle, islice

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ravelin.plans import generation

NOISE, ROWS = "noise_of", "noise_rows"


def bank(variant: str, sentences: list[str]) -> list[str]:
    """The mock generator's sentences of a variant for the sentences of a problem; none for other variants."""
    if variant == "TB":
        topic = "bookmark sales" if "bookmark" in " ".join(sentences).lower() else "school supplies"
        return [s.replace("{topic}", topic) for s in generation.BACKGROUND]
    if variant == "SP":
        return [s.replace("Then ", "After that, ").replace("How many", "Determine how many") for s in sentences[:-1] if s]
    return {"PED": generation.PARALLEL, "HU": generation.HEDGED}.get(variant, [])


def items(variant: str, sentences: list[str] | None, before: int, after: int) -> Iterator[tuple[str, int, str]]:
    """(position, k, text): `before` sentences, then `after` more; the paraphrase goes round, other banks end."""
    own = bank(variant, [s for s in sentences or [] if s is not None])
    made = list(islice(cycle(own), before + after) if variant == "SP" else own[: before + after])
    for k, s in enumerate(made):
        yield ("before", k, s) if k < before else ("after", k - before, s)


@udtf(returnType="position string, k int, text string")
class NoiseOf:
    """noise_of(sentences, variant, before, after): the rows of one problem, for a lateral join."""

    def eval(self, sentences: list, variant: str, before: int, after: int) -> Iterator[tuple]:
        yield from items(variant, sentences, before, after)


@udtf(returnType="id string, variant string, position string, k int, text string")
class NoiseRows:
    """noise_rows(TABLE(problems), variants, before, after): the rows of all problems (id, core_sentences) and variants of a list."""

    def eval(self, row: Row, variants: list, before: int, after: int) -> Iterator[tuple]:
        for v in variants:
            for item in items(v, row["core_sentences"], before, after):
                yield (row["id"], v, *item)


def register(spark: SparkSession) -> None:
    spark.udtf.register(NOISE, NoiseOf)
    spark.udtf.register(ROWS, NoiseRows)

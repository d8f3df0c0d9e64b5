"""Metrics by name, beside the built-in ones: expressions of columns, sums, and functions of whole groups, all of them callable from SQL.

An expression is planned by Catalyst. A metric of sums maps a batch of rows to numbers that add up, so its rows are summed in part before the shuffle, however large a
group is. A metric of groups gets all values of a group at once as Arrow arrays, in one task: it is for groups whose size is bounded by what they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.relational import METRICS


@dataclass(frozen=True)
class Sums:
    """rows: (pred, gold) arrays -> an array of doubles for each of n numbers; result: the sums as columns -> the metric."""

    n: int
    rows: Callable[[pa.Array, pa.Array], list[pa.Array]]
    result: Callable[..., Column]

    def __call__(self, pred: Column, gold: Column) -> Column:
        @F.arrow_udf("array<double>")
        def numbers(p: pa.Array, g: pa.Array) -> pa.Array:
            made = self.rows(p, g)
            flat = pa.table([m.cast(pa.float64()) for m in made], names=[str(k) for k in range(self.n)])
            return pa.array([list(r.values()) for r in flat.to_pylist()], pa.list_(pa.float64()))

        row = numbers(pred, gold)
        return self.result(*[F.coalesce(F.sum(F.get(row, F.lit(k))), F.lit(0.0)) for k in range(self.n)])


@dataclass(frozen=True)
class Whole:
    """group: (pred, gold) arrays of a whole group -> the metric; kind: of its value."""

    group: Callable[[pa.Array, pa.Array], float]
    kind: str = "double"

    def function(self):
        group = self.group

        def of_group(p: pa.Array, g: pa.Array) -> float:
            return group(p, g)

        return F.arrow_udf(of_group, self.kind)

    def __call__(self, pred: Column, gold: Column) -> Column:
        return self.function()(pred, gold)


def register(name: str, metric: Callable[[Column, Column], Column], spark: SparkSession | None = None) -> None:
    """Makes a metric known by name, and a metric of groups to a session's SQL too."""
    METRICS[name] = metric
    if spark is not None and isinstance(metric, Whole):
        spark.udf.register(name, metric.function())


def measured(df: DataFrame, names: list[str], pred: str, gold: str, by: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A row for each group of the known metrics by name, and the names that are unknown. Metrics of whole groups stand in an aggregate of their own, joined by group."""
    known = [n for n in dict.fromkeys(names) if n in METRICS]
    by = by or []
    whole = [n for n in known if isinstance(METRICS[n], Whole)]
    rest = [n for n in known if n not in whole]
    parts = [df.groupBy(*by).agg(*[METRICS[n](F.col(pred), F.col(gold)).alias(n) for n in some]) for some in (rest, whole) if some]
    if not parts:
        parts = [df.groupBy(*by).agg(F.count("*").alias("n"))]
    out = parts[0]
    for other in parts[1:]:
        other = other.withColumnsRenamed({b: f"_{b}" for b in by})
        same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        out = out.join(other, same or F.lit(True)).drop(*[f"_{b}" for b in by])
    return out.select(*by, *(known or ["n"])), [n for n in names if n not in METRICS]

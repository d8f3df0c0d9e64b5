"""Small aggregates as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.plans import ablation

ORDER = [r[0] for r in ablation.CONDITIONS + ablation.STEP_CONDITIONS + ablation.COMMIT_CONDITIONS]


def table(rows: list[dict], columns: list[str]) -> str:
    """Columns side by side, numbers with two places."""
    shown = [[("-" if r.get(c) is None else f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c])) for c in columns] for r in rows]
    width = [max(map(len, col)) for col in zip(columns, *shown, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, width, strict=True)).rstrip() for line in [columns, *shown])


def accuracy_report(results: DataFrame) -> str:
    """Accuracy by condition and variant, in the order of conditions, and differences to the base conditions."""
    place = {m: k for k, m in enumerate(ORDER)}
    acc = sorted((r.asDict() for r in ablation.accuracy_table(results).collect()), key=lambda r: place.get(r["mode"], len(place)))
    delta = [r.asDict() for r in ablation.deltas(results).orderBy("mode", "variant").collect()]
    return table(acc, list(acc[0]) if acc else ["mode"]) + "\n\n" + table(delta, ["mode", "variant", "base_mode", "delta"])


def error_report(results: DataFrame) -> str:
    rows = ablation.error_report(results).orderBy(F.col("setting"))
    return table([r.asDict() for r in rows.collect()], rows.columns)

"""How many independent sources agree on a row, and how far to trust them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def concurrence(spine: DataFrame, keys: list[str], signals: dict[str, DataFrame]) -> DataFrame:
    """Adds a flag for each signal and ``source_concurrence``, the number of flags that are set.

    All signals are grouped together before the join, so the spine is shuffled once however many
    there are, and a key with many rows of a signal sends one. A null key matches nothing.
    """
    rows = reduce(DataFrame.unionByName, [df.select(*keys, F.lit(name).alias("_signal")) for name, df in signals.items()])
    seen = rows.groupBy(*keys).agg(*[F.max(F.col("_signal") == name).alias(name) for name in signals])
    met = spine.join(seen, keys, "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in signals})
    return met.withColumn("source_concurrence", reduce(Column.__add__, [F.col(name).cast("int") for name in signals]))


def confidence(year: Column, count: Column, eras: list[tuple[int | None, dict[str, int]]], lowest: str = "low") -> Column:
    """Grade of a count by the thresholds of its era: (first year after it, or None for the last
    one; label to least count). The label of the highest threshold that is reached counts."""
    out = F.lit(lowest)
    for until, steps in reversed(eras):
        grade = F.lit(lowest)
        for label, least in sorted(steps.items(), key=lambda step: step[1]):
            grade = F.when(count >= least, label).otherwise(grade)
        out = grade if until is None else F.when(year < until, grade).otherwise(out)
    return out


def first_reason(reasons: dict[str, Column]) -> Column:
    """Label of the first condition that holds; NULL where none does."""
    return F.coalesce(*[F.when(holds, label) for label, holds in reasons.items()])

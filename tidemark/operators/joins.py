"""Joins that the DataFrame API lacks, composed of joins and windows that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.lineage import closure as walk  # noqa: F401 - its name before it moved
from tidemark.operators.ordered import scan


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, observed: str, values: list[str], within: str | None = None) -> DataFrame:
    """Each left row with the latest right row of its keys observed at or before ``at``.

    Rows of the two sides are merged in time order within a key and dealt by ranges of it, so a key
    with many rows lies in many tasks; the last right row seen is carried forward, from one range
    into the next ones too. No pair of rows is built. ``within`` is an interval that the
    observation must be younger than. Of observations at one time the largest ``values`` count.
    """
    carried = F.struct(F.col(observed).alias("observed"), *[F.col(v) for v in values])
    a = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_seen": F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType)})
    b = right.select(*keys, F.col(observed).alias("_at"), F.lit(0).alias("_side"), carried.alias("_seen"))
    merged = a.unionByName(b, allowMissingColumns=True)
    found = scan(merged, keys, ["_at", "_side", "_seen"], lasts={"_last": F.col("_seen")}).filter("_side = 1")
    last = F.col("_last")
    if within:
        last = F.when(F.col("_last.observed") > F.col("_at") - F.expr(f"interval {within}"), F.col("_last"))
    return found.withColumn("_last", last).select(*left.columns, F.col("_last.observed").alias(f"asof_{observed}"), *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in values])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, observed: str, before_hours: int, after_hours: int) -> DataFrame:
    """Right rows observed within [at - before, at + after], in absolute hours.

    An equi join on keys and day buckets; each left row takes the few days its interval touches.
    """
    day = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 86_400_000_000)
    low, high = F.col(at) - F.expr(f"interval {before_hours} hours"), F.col(at) + F.expr(f"interval {after_hours} hours")
    days = left.withColumn("_day", F.explode(F.sequence(day(low), day(high))))
    return days.join(right.withColumn("_day", day(F.col(observed))), [*keys, "_day"]).filter(F.col(observed).between(low, high)).drop("_day")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """DISTINCT ON: the first row of each key in ``order``, which should leave no ties."""
    return top_per_key(df, keys, 1, *order).drop("rank_in_key")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows of a key per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_in_key", place).filter(F.col("rank_in_key") <= n)


def mode_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key, ties to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return latest_per_key(counts, keys, F.desc("n"), F.asc(value))


def role_union(df: DataFrame, roles: dict[str, str], kept: list[str]) -> DataFrame:
    """A row for each role column of a fact, in one pass over it."""
    credits = F.array(*[F.struct(F.lit(role).alias("role"), F.col(column).cast("long").alias("subject")) for role, column in roles.items()])
    return df.select(*kept, F.explode(credits).alias("_c")).select(*kept, "_c.*").filter("subject is not null")

"""Running values, ranks and quantiles over whole orders, however many rows a key has.

Rows are dealt by ranges of (keys, order), so a key with many rows lies in many tasks and a task
holds a bounded run of the order. Each run is scanned by itself; what a key has gathered in earlier
runs is carried in. A run can continue at most one key, so there are no more carried rows than
runs, and they are broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.storage import Workspace


def tasks(df: DataFrame, rows: int = 250_000) -> int:
    """How many tasks a table is dealt to so that each has about ``rows`` rows, however large it is;
    Parquet footers hold the count. A number given to ``repartition`` is kept, whereas the tasks of
    other shuffles are merged by their bytes and so hold ever more rows as compression allows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def join_by(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``left`` with the other columns of ``right``; null keys are equal to each other."""
    renamed = right.withColumnsRenamed({c: f"_j_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(renamed, on, how).drop(*[f"_j_{c}" for c in keys])


def scan(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """``df`` with running sums, and last values that are not null, of each key up to a row, or up to
    the row ``before`` it.

    ``order`` ascends, nulls first. Rows that agree in keys and order stand together, in any order,
    so give an order without ties where that matters. A sum starts from NULL, and null keys are a
    key like others.
    """
    sums, lasts = sums or {}, lasts or {}
    dealt = df.withColumns({f"_v_{n}": c for n, c in (sums | lasts).items()}).repartitionByRange(*keys, *order).withColumn("_run", F.spark_partition_id())
    space = Workspace(df.sparkSession, "scan")
    rows = space.save(dealt, "runs")
    ordered = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(ordered) for n in sums} | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(ordered) for n in lasts})
    if space.files("runs") < 2:  # one run holds everything, so nothing is carried
        return local.select(*df.columns, *[F.col(f"_l_{n}").alias(n) for n in (*sums, *lasts)])
    place = [F.col(c) for c in order]
    gathered = {n: F.sum(f"_v_{n}") for n in sums} | {n: F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*place, F.col(f"_v_{n}").alias("_value")))) for n in lasts}
    totals = rows.groupBy(*keys, "_run").agg(*[c.alias(f"_c_{n}") for n, c in gathered.items()])
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_run", F.count("*").over(earlier).alias("_runs"), *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums], *[F.last(F.col(f"_c_{n}")["_value"], ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts])
    carried = F.broadcast(carried.filter("_runs > 0").drop("_runs"))
    met = join_by(local, carried, [*keys, "_run"], "left")
    total = lambda n: F.when(F.col(f"_l_{n}").isNull(), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0)))
    return met.select(*df.columns, *[total(n).alias(n) for n in sums], *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Places from 1 in an ascending order without ties."""
    return scan(df, keys, order, sums={name: F.lit(1).cast("long")})


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, through): how many rows have a value that is not null, and how many that or a smaller one."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return scan(counts, keys, [value], sums={"through": F.col("n")})


def competition_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks by a numeric value, the largest first; equal values share a rank and the next one skips.
    Only distinct values are put in order, so a value that many rows share is one row of it. Rows
    without a value have no rank."""
    falling = df.withColumn("_falling", -F.col(value))
    counts = value_counts(falling, keys, "_falling")
    ranks = counts.select(*keys, "_falling", (F.col("through") - F.col("n") + 1).alias(name))
    return join_by(falling, ranks, [*keys, "_falling"], "left").select(*df.columns, name)


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact quantiles of each key: a column for each name of ``points`` (fraction, kind).

    Kinds: ``disc``, the smallest value that so large a part of the rows does not exceed; ``cont``,
    between neighbours. Nulls do not count.
    The counts of distinct values are scanned in order and each rank falls on one value, so no
    group's values meet in a buffer.
    """
    counts = value_counts(df, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    met = join_by(counts, totals, keys, "inner")
    at = lambda place: F.max(F.when((F.col("through") >= place) & (F.col("through") - F.col("n") < place), F.col(value)))
    found = {}
    for name, (part, kind) in points.items():
        share = F.lit(Decimal(str(part)))
        if kind == "cont":
            exact = share * (F.col("_all") - 1)
            low, high = at(F.floor(exact) + 1).cast("double"), at(F.ceil(exact) + 1).cast("double")
            # The fraction is the same for all rows of a key.
            found[name] = low + (high - low) * F.max(exact - F.floor(exact)).cast("double")
        else:
            found[name] = at(F.greatest(F.ceil(share * F.col("_all")), F.lit(1)))
    return met.groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])

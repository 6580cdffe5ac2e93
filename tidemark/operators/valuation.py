"""Replacement baselines, values above them and prices.

Rosters are filled by ranks: row numbers within a position decide the fixed slots, row numbers among
those left over decide the flexible ones. Row-number filters keep only so many rows of a group in
each task before the shuffle, so a pool of any size costs its slots, not a sort of everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def starters(pool: DataFrame, period: list[str], position: str, value: str, tie: str, slots: dict[str, int], flexible: tuple[tuple[str, ...], int] = ((), 0)) -> DataFrame:
    """Rows that fill a roster: the best of each position, then the best of the rest of the
    positions that may take a flexible slot. Slots nest, so taking the best first is optimal."""
    order = (F.desc(value), F.asc(tie))
    asked = F.coalesce(*[F.when(F.col(position) == p, F.lit(n)) for p, n in slots.items()], F.lit(0))
    extra = flexible[1]
    placed = pool.withColumn("_place", F.row_number().over(Window.partitionBy(*period, position).orderBy(*order)))
    placed = placed.filter(F.col("_place") <= max(slots.values()) + extra).withColumn("_slots", asked)
    fixed = placed.filter(F.col("_place") <= F.col("_slots")).withColumn("slot", F.col(position))
    if not extra:
        return fixed.drop("_place", "_slots")
    rest = placed.filter((F.col("_place") > F.col("_slots")) & F.col(position).isin(*flexible[0]))
    rest = rest.withColumn("_flex", F.row_number().over(Window.partitionBy(*period).orderBy(*order))).filter(F.col("_flex") <= extra)
    return fixed.unionByName(rest.drop("_flex").withColumn("slot", F.lit("FLEX"))).drop("_place", "_slots")


def slot_capacities(slots: list[tuple[tuple[str, ...], int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Positions, and for each set of them (as bits) how many slots take one of the set at least."""
    positions = sorted({p for eligible, _ in slots for p in eligible})
    bits = {p: 1 << i for i, p in enumerate(positions)}
    masks = [(sum(bits[p] for p in eligible), n) for eligible, n in slots]
    return positions, [(s, sum(n for m, n in masks if m & s)) for s in range(1, 1 << len(positions))]


def lineups(pool: DataFrame, period: list[str], position: str, value: str, tie: str, slots: list[tuple[tuple[str, ...], int]]) -> DataFrame:
    """The best lineup of each group ``period``: rows that slots (positions they take, how many) can
    hold together with the largest sum, as many as there can be. Slots may overlap in any way.

    Rows that slots can hold together form a transversal matroid, so taking the best row that still
    fits is optimal. A row fits (Hall's condition) if for each set of positions with its own one
    the rows taken of the set are fewer than the slots that take any of it; a counter for each set
    is all the state. Of a position no more rows can matter than slots take it, so a group is cut to
    its slots in each task before the shuffle, and what is folded is no longer than they are many.
    Ties go to the smaller ``tie``; rows without a value and of positions without a slot stay out.
    """
    positions, capacities = slot_capacities(slots)
    if len(positions) > 10:
        raise ValueError("a counter is kept for each set of positions; name 10 positions at most")
    code = F.coalesce(*[F.when(F.col(position) == p, F.lit(i)) for i, p in enumerate(positions)])
    most = F.coalesce(*[F.when(F.col(position) == p, F.lit(sum(n for eligible, n in slots if p in eligible))) for p in positions])
    asked = pool.filter(F.col(position).isin(positions) & F.col(value).isNotNull())
    place = F.row_number().over(Window.partitionBy(*period, position).orderBy(F.desc(value), F.asc(tie)))
    best = asked.withColumn("_place", place).filter(F.col("_place") <= max(n for _, n in capacities)).filter(F.col("_place") <= most)
    row = F.struct((-F.col(value)).alias("falling"), F.col(tie).alias("tie"), code.alias("code"), F.struct(position, value).alias("row"))
    groups = best.groupBy(*period).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sets = F.array(*[F.struct(F.lit(s).alias("set"), F.lit(n).alias("most")) for s, n in capacities])

    def holds(s, r):
        return F.getbit(s["set"], r["code"]) == 1

    def taken(state, r):
        fits = F.forall(F.zip_with(state["used"], sets, lambda used, s: ~holds(s, r) | (used < s["most"])), lambda ok: ok)
        used = F.zip_with(state["used"], sets, lambda used, s: used + holds(s, r).cast("int"))
        return F.when(fits, F.struct(used.alias("used"), F.concat(state["rows"], F.array(r)).alias("rows"))).otherwise(state)

    start = F.struct(F.array_repeat(F.lit(0), len(capacities)).alias("used"), F.filter("rows", lambda r: F.lit(False)).alias("rows"))
    chosen = groups.select(*period, F.explode(F.aggregate("rows", start, taken)["rows"]).alias("r"))
    return chosen.select(*period, F.col("r.tie").alias(tie), "r.row.*")


def baselines(chosen: DataFrame, period: list[str], position: str, value: str) -> DataFrame:
    """The worst starter of each position."""
    return chosen.groupBy(*period, position).agg(F.min(value).alias("baseline"))


def points_added(pool: DataFrame, base: DataFrame, period: list[str], position: str, value: str) -> DataFrame:
    """``added`` over the baseline; NULL for a position without one."""
    return pool.join(base, [*period, position], "left").withColumn("added", F.col(value) - F.col("baseline"))


def priced(valued: DataFrame, period: list[str], cap: float) -> DataFrame:
    """``price``: a period's cap shared out by positive surplus."""
    surplus = valued.groupBy(*period).agg(F.sum(F.when(F.col("added") > 0, F.col("added"))).alias("_surplus"))
    rate = F.try_divide(F.lit(cap), F.col("_surplus").cast("double"))
    return valued.join(surplus, period).withColumn("price", F.greatest(F.round(rate * F.col("added").cast("double")), F.lit(0.0))).drop("_surplus")


def top_average(df: DataFrame, keys: list[str], value: str, sizes: dict[str, int], position: str) -> DataFrame:
    """Mean of the best rows of each key, as many as its position asks for."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    best = df.withColumn("_place", place).filter(F.col("_place") <= max(sizes.values()))
    asked = F.coalesce(*[F.when(F.col(position) == p, F.lit(n)) for p, n in sizes.items()])
    return best.filter(F.col("_place") <= asked).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("average"), F.count("*").alias("n"))


def min_max(value: Column, *keys: str) -> Column:
    """Scaled to [0, 1] within its keys; NULL where all are equal."""
    own = Window.partitionBy(*keys)
    return F.try_divide(value - F.min(value).over(own), F.max(value).over(own) - F.min(value).over(own))

"""Trailing hit rates, daily carry-forward, changes between versions, joint rates of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hit_rates(logs: DataFrame, subject: str, season: str, order: list[str], hit: Column, windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Rates of a row's own past, the row itself left out: last so many games, this season, the
    last season, all. NULL without a past. One sort by subject; the last season is a join."""
    career = Window.partitionBy(subject).orderBy(*order)
    in_season = Window.partitionBy(subject, season).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = logs.withColumn("_hit", hit.cast("double"))
    before = marked.groupBy(subject, season).agg(F.avg("_hit").alias("last_season")).withColumn(season, F.col(season) + 1)
    rates = {f"last_{n}": F.avg("_hit").over(career.rowsBetween(-n, -1)) for n in windows}
    rates |= {"all_before": F.avg("_hit").over(career.rowsBetween(Window.unboundedPreceding, -1)), "this_season": F.avg("_hit").over(in_season)}
    return marked.withColumns(rates).join(before, [subject, season], "left").drop("_hit")


def daily_carry(events: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """A row for each day between a key's first and last event, with the latest value so far."""
    day = F.to_date(at)
    last = events.groupBy(key, day.alias("day")).agg(F.max(F.struct(at, tie, value))[value].alias("value"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy(key).orderBy("day")), F.date_add("day", 1))
    return last.withColumn("_until", until).select(key, F.explode(F.sequence("day", F.date_sub("_until", 1))).alias("day"), "value")


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each value of ``new`` that differs from ``old``, NULL being a value like others."""
    before = old.select(*keys, F.struct(*columns).alias("_old"))
    both = new.select(*keys, F.struct(*columns).alias("_new")).join(before, keys, "left")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_old.{c}").cast("string").alias("old"), F.col(f"_new.{c}").cast("string").alias("new")) for c in columns])
    return both.select(*keys, F.explode(rows).alias("_c")).select(*keys, "_c.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def correlation(x: Column, y: Column) -> Column:
    """Correlation as an aggregate: NaN where one of the two does not vary, NULL without a pair of values.
    Spark's own divides by the spread and fails there by an error, even of groups that a later filter drops."""
    both = x.isNotNull() & y.isNotNull()
    shared = F.covar_pop(x, y)
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(shared.isNotNull(), F.coalesce(F.try_divide(shared, spread), F.lit(float("nan"))))


def pair_correlations(values: DataFrame, group: str, member: str, value: str, least: int, shrink: float, tasks: int | None = None) -> DataFrame:
    """Correlation of two members' values over the groups that both are in, ``least`` of them or
    more, and its shrinkage; both are NaN where a member's values are all the same. Groups are
    rosters of a game, so pairs within one are few. Members of fewer groups have no such pair and
    leave before any is made. Groups are dealt to ``tasks`` tasks and pairs, which hardly shrink
    before they meet, to four times as many, if given."""
    deal = lambda df, n, *keys: df.repartition(n * tasks, *keys) if tasks else df
    often = values.groupBy(member).agg(F.count_distinct(group).alias("_in")).filter(F.col("_in") >= least).select(member)
    values = deal(values.join(often, member, "left_semi"), 1, group)
    a = values.select(group, F.col(member).alias("a"), F.col(value).alias("x"))
    b = values.select(group, F.col(member).alias("b"), F.col(value).alias("y"))
    met = deal(a.join(b, group).filter("a < b").select("a", "b", "x", "y"), 4, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("r"))
    return met.filter(F.col("n") >= least).withColumn("shrunk", F.col("r") * F.col("n") / (F.col("n") + shrink))


def parlays(legs: DataFrame, wager: str, state: str, odds: str) -> DataFrame:
    """Wagers from their legs: lost by one lost leg, open while one is open, else won at the product
    of the odds of its legs; a push counts 1. ``near_miss``: one leg alone was lost."""
    count = lambda s: F.count(F.when(F.col(state) == s, 1))
    price = F.exp(F.sum(F.log(F.when(F.col(state) == "PUSH", 1.0).otherwise(F.col(odds).cast("double")))))
    made = legs.groupBy(wager).agg(F.count("*").alias("legs"), count("LOST").alias("lost"), F.count(F.when(F.col(state).isNull(), 1)).alias("open"), F.round(price, 6).alias("odds"))
    result = F.when(F.col("lost") > 0, "LOST").when(F.col("open") > 0, "OPEN").otherwise("WON")
    return made.withColumns({"result": result, "near_miss": (F.col("lost") == 1) & (F.col("open") == 0)})

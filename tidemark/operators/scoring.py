"""Points: weighted stats, bands, bonuses, blends of sources. All are column expressions or one
aggregation; weights are decimals, so that sums are exact and do not depend on the order of rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

Weights = dict[str, str]


def points(weights: Weights, overrides: dict[str, Weights] | None = None, position: Column | None = None) -> Column:
    """Sum of weight times stat, missing stats 0. ``overrides`` has other weights for some positions."""
    total = F.lit(Decimal(0))
    for stat, weight in weights.items():
        factor = F.lit(Decimal(weight))
        for where, changed in (overrides or {}).items():
            if stat in changed:
                factor = F.when(position == where, F.lit(Decimal(changed[stat]))).otherwise(factor)
        total = total + F.coalesce(F.col(stat), F.lit(Decimal(0))) * factor
    return total


def banded(value: Column, bands: list[tuple[float, str]], per_unit: str = "0", at_least: int = 0) -> Column:
    """The points of the first band whose upper bound is not below the value, or of the last one,
    and ``per_unit`` for each unit of the value, ``at_least`` units."""
    band = F.lit(Decimal(bands[-1][1]))
    for bound, worth in reversed(bands[:-1]):
        band = F.when(value <= bound, F.lit(Decimal(worth))).otherwise(band)
    return F.when(value.isNotNull(), band + F.lit(Decimal(per_unit)) * F.greatest(value, F.lit(Decimal(at_least))))


def milestones(total: Column, steps: list[tuple[int, str]]) -> Column:
    """Every milestone that a game's total reaches counts once."""
    return sum((F.when(total >= bound, F.lit(Decimal(worth))).otherwise(F.lit(Decimal(0))) for bound, worth in steps), F.lit(Decimal(0)))


def season_points(plays: DataFrame, subject: list[str], game: str, stat: str, weight: str, steps: list[tuple[int, str]], big: tuple[int, str]) -> DataFrame:
    """Points of each subject: its stat weighted, milestones of each game, a bonus for each big play.
    Two aggregations; games are combined in the map tasks first."""
    games = plays.groupBy(*subject, game).agg(F.sum(stat).alias("_total"), F.count(F.when(F.col(stat) >= big[0], 1)).cast("decimal(18,0)").alias("_big"))
    worth = F.col("_total") * F.lit(Decimal(weight)) + milestones(F.col("_total"), steps) + F.col("_big") * F.lit(Decimal(big[1]))
    return games.groupBy(*subject).agg(F.sum(worth).alias("points"), F.count("*").alias("games"))


def blend(values: dict[str, str]) -> tuple[Column, Column]:
    """Weighted mean over the columns that are there, and the share of the weights that they have."""
    none = F.lit(Decimal(0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(Decimal(w))).otherwise(none) for c, w in values.items()), none)
    total = sum((F.coalesce(F.col(c) * F.lit(Decimal(w)), none) for c, w in values.items()), none)
    return F.try_divide(total, weight), weight / F.lit(sum(map(Decimal, values.values())))


def stat_lines(rows: DataFrame, keys: list[str], kind: str, value: str, rules: dict[str, tuple[tuple[str, ...], bool]]) -> DataFrame:
    """Coded stat rows to one line for each key: a column counts the rows of its codes, or sums their
    values. One aggregation, whatever the number of columns."""
    made = [(F.sum(F.when(F.col(kind).isin(*codes), F.col(value))) if summed else F.count(F.when(F.col(kind).isin(*codes), 1))).alias(name) for name, (codes, summed) in rules.items()]
    return rows.groupBy(*keys).agg(*made)


def success(gained: Column, to_go: Column, down: Column, shares: tuple[float, float, float] = (0.4, 0.6, 1.0)) -> Column:
    """Whether a play gained the share of the distance that its down asks for; NULL if unknown."""
    asked = F.when(down == 1, shares[0]).when(down == 2, shares[1]).when(down.isin(3, 4), shares[2])
    return gained >= to_go * asked

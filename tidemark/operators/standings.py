"""Standings of teams: records from ranks and joins; no pairs of teams are built for all-play."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.valuation import min_max


def all_play(scores: DataFrame, period: list[str], score: str) -> DataFrame:
    """Adds wins, losses and ties against every other team of the period, by rank, not by pairs."""
    own = Window.partitionBy(*period)
    wins = (F.rank().over(own.orderBy(score)) - 1).cast("long")
    losses = (F.rank().over(own.orderBy(F.desc(score))) - 1).cast("long")
    return scores.withColumns({"ap_wins": wins, "ap_losses": losses}).withColumn("ap_ties", F.count("*").over(own) - 1 - F.col("ap_wins") - F.col("ap_losses"))


def head_to_head(scores: DataFrame, matchups: DataFrame, period: list[str], team: str, score: str) -> DataFrame:
    """A row for each side of a matchup (``home``, ``away``) with both scores; a missing score is 0."""
    sides = matchups.select(*period, F.explode(F.array(F.struct(F.col("home").alias(team), F.col("away").alias("opponent")), F.struct(F.col("away").alias(team), F.col("home").alias("opponent")))).alias("_s")).select(*period, "_s.*")
    other = scores.select(*period, F.col(team).alias("opponent"), F.col(score).alias("against"))
    met = sides.join(scores.select(*period, team, score), [*period, team], "left").join(other, [*period, "opponent"], "left")
    zero = F.lit(0).cast(scores.schema[score].dataType)
    return met.withColumns({score: F.coalesce(score, zero), "against": F.coalesce("against", zero)})


def records(games: DataFrame, keys: list[str], score: str) -> DataFrame:
    won, lost = F.col(score) > F.col("against"), F.col(score) < F.col("against")
    count = lambda c: F.count(F.when(c, 1))
    return games.groupBy(*keys).agg(
        count(won).alias("wins"), count(lost).alias("losses"), count(~won & ~lost).alias("ties"), F.sum(score).alias("points_for"), F.sum("against").alias("points_against"),
        F.stddev_pop(F.col(score).cast("double")).alias("deviation"), F.max(score).alias("high"), F.min(score).alias("low"),
    )


def draft_order_index(table: DataFrame, season: list[str], potential: str, all_play_share: str) -> DataFrame:
    """Nine parts potential points to one part all-play record, both scaled within the season."""
    return table.withColumn("draft_index", 9 * min_max(F.col(potential).cast("double"), *season) + min_max(F.col(all_play_share).cast("double"), *season))


def seeded(table: DataFrame, season: list[str], division: str, team: str) -> DataFrame:
    """Winners of divisions first, then by wins, ties, points and team."""
    order = (F.desc("wins"), F.desc("ties"), F.desc("points_for"), F.asc(team))
    first = F.row_number().over(Window.partitionBy(*season, division).orderBy(*order)) == 1
    table = table.withColumn("division_winner", first)
    return table.withColumn("seed", F.row_number().over(Window.partitionBy(*season).orderBy(F.desc("division_winner"), *order)).cast("long"))


@dataclass(frozen=True)
class PlayoffRules:
    """How many teams play on, how many of them have a bye, and what selects them.

    Byes go to the best of the ``bye_pool`` (``league`` or ``division_winners``) by ``bye_by``; then
    division winners may be sure of a place, ``record_berths`` go by record, and the rest at large by
    ``at_large_by``. Ladders are ``record``, ``all_play`` and ``points``.
    """

    teams: int
    byes: int
    bye_pool: str = "league"
    bye_by: str = "record"
    at_large_by: str = "record"
    division_berths: bool = False
    record_berths: int = 0

    def __post_init__(self):
        if self.teams < 1 or not 0 <= self.byes <= self.teams or not 0 <= self.record_berths <= self.teams - self.byes:
            raise ValueError("byes and record berths must fit the places")
        if self.bye_pool not in ("league", "division_winners") or self.bye_by not in ("record", "all_play") or self.at_large_by not in ("record", "all_play", "points"):
            raise ValueError("unknown pool or ladder")


def playoff_field(table: DataFrame, season: list[str], division: str, team: str, rules: PlayoffRules) -> DataFrame:
    """``table`` (wins, losses, ties, ap_wins, ap_losses, ap_ties, points_for) with ``division_winner``,
    ``berth`` (bye, division, record, at_large, or NULL) and ``seed``.

    Byes come first in the order of their own ladder, then the rest of the field and the teams that
    missed it by record: a sure place does not lift a team past a better one. Full ties go to the
    smaller ``team``. Where fewer places than division winners are left, the best of them take them,
    and a season with fewer teams than places has a berth for each.
    """
    played = F.col("ap_wins") + F.col("ap_losses") + F.col("ap_ties")
    table = table.withColumn("_ap", F.coalesce(F.try_divide(F.col("ap_wins") + F.col("ap_ties") / 2, F.nullif(played, F.lit(0))), F.lit(0.0)))
    ladders = {
        "record": [F.desc("wins"), F.asc("losses"), F.desc("ties"), F.desc("_ap"), F.desc("points_for"), F.asc(team)],
        "all_play": [F.desc("_ap"), F.desc("points_for"), F.asc(team)], "points": [F.desc("points_for"), F.desc("_ap"), F.asc(team)],
    }
    own = Window.partitionBy(*season)
    first = F.row_number().over(Window.partitionBy(*season, division).orderBy(*ladders["record"])) == 1
    table = table.withColumn("division_winner", first)
    candidate = F.col("division_winner") if rules.bye_pool == "division_winners" else F.lit(True)
    table = table.withColumn("_candidate", candidate).withColumn("_bye_place", F.row_number().over(own.orderBy(F.desc("_candidate"), *ladders[rules.bye_by])))
    bye = F.col("_candidate") & (F.col("_bye_place") <= rules.byes)
    table = table.withColumn("berth", F.when(bye, "bye"))

    def award(df: DataFrame, name: str, among: Column, ladder: str, most: int | Column) -> DataFrame:
        """Up to so many teams without a berth, of those ``among``, get one, while places last."""
        open_ = F.col("berth").isNull() & among
        taken = F.count("berth").over(own)
        place = F.row_number().over(own.orderBy(F.desc("_open"), *ladders[ladder]))
        df = df.withColumns({"_open": open_, "_taken": taken}).withColumn("_place", place)
        return df.withColumn("berth", F.when(F.col("_open") & (F.col("_place") <= F.least(F.lit(most), rules.teams - F.col("_taken"))), name).otherwise(F.col("berth"))).drop("_open", "_taken", "_place")

    if rules.division_berths:
        table = award(table, "division", F.col("division_winner"), "record", rules.teams)
    table = award(table, "record", F.lit(True), "record", rules.record_berths)
    table = award(table, "at_large", F.lit(True), rules.at_large_by, rules.teams)
    stage = F.when(F.col("berth") == "bye", 0).when(F.col("berth").isNotNull(), 1).otherwise(2)
    table = table.withColumns({"_stage": stage, "_first": F.when(F.col("berth") == "bye", F.col("_bye_place")).otherwise(F.lit(0))})
    seed = F.row_number().over(own.orderBy("_stage", "_first", *ladders["record"])).cast("long")
    return table.withColumn("seed", seed).drop("_ap", "_candidate", "_bye_place", "_stage", "_first")

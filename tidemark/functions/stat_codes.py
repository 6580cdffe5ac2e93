"""What coded stat rows add to a line: tables of fixed values, and one aggregation that applies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Adds:
    """Rows with one of ``codes`` (for which ``where`` holds) add ``worth`` to the column, or offer it
    as its largest value (``longest``)."""

    column: str
    codes: tuple[int, ...]
    worth: str = "1"
    where: str = "true"
    longest: bool = False


# The codes of the public play-by-play feed, and what a player's line takes from them.
PLAYER_LINE = (
    Adds("rushing_attempts", (10, 11)),
    Adds("rushing_yards", (10, 11, 12, 13), "stat_yards"),
    Adds("rushing_yards_excluding_kneels", (10, 11, 12, 13), "stat_yards", "NOT coalesce(is_qb_kneel, false)"),
    Adds("rushing_touchdowns", (11, 13)),
    Adds("rushing_first_downs", (10, 11), where="is_first_down"),
    Adds("rushing_first_downs_excluding_touchdowns", (10,), where="is_first_down"),
    Adds("longest_rush", (10, 11, 12, 13), "stat_yards", longest=True),
    Adds("rush_attempts_redzone", (10, 11), where="yard_line_100 <= 20"),
    Adds("rush_attempts_goal_line", (10, 11), where="yard_line_100 <= 5"),
    Adds("passing_attempts", (14, 15, 16, 19)),
    Adds("passing_completions", (15, 16)),
    Adds("passing_yards", (15, 16), "stat_yards"),
    Adds("passing_touchdowns", (16,)),
    Adds("passing_interceptions", (19,)),
    Adds("passing_air_yards", (111, 112), "stat_yards"),
    Adds("receptions", (21, 22)),
    Adds("receiving_yards", (21, 22, 23, 24), "stat_yards"),
    Adds("receiving_touchdowns", (22, 24)),
    Adds("receiving_first_downs", (21, 22), where="is_first_down"),
    Adds("receiving_first_downs_excluding_touchdowns", (21,), where="is_first_down"),
    Adds("receiving_yards_15_plus_count", (21, 22), where="stat_yards >= 15"),
    Adds("longest_reception", (21, 22), "stat_yards", longest=True),
    Adds("targets", (115,)),
    Adds("targeted_air_yards", (115,), "depth_of_target"),
    Adds("redzone_targets", (115,), where="yard_line_100 <= 20"),
    Adds("field_goal_attempts", (69, 70)),
    Adds("field_goals_made", (70,)),
    Adds("field_goal_yards", (70,), "greatest(stat_yards, 30)"),
    Adds("field_goals_made_0_19_yards", (70,), where="stat_yards < 20"),
    Adds("field_goals_made_20_29_yards", (70,), where="stat_yards >= 20 AND stat_yards < 30"),
    Adds("field_goals_made_30_39_yards", (70,), where="stat_yards >= 30 AND stat_yards < 40"),
    Adds("field_goals_made_40_49_yards", (70,), where="stat_yards >= 40 AND stat_yards < 50"),
    Adds("field_goals_made_50_plus_yards", (70,), where="stat_yards >= 50"),
    Adds("extra_point_attempts", (72, 73)),
    Adds("extra_points_made", (72,)),
    Adds("punt_return_touchdowns", (34, 36)),
    Adds("kickoff_return_touchdowns", (46, 48)),
    Adds("fumble_return_touchdowns", (56, 58, 60, 62)),
    Adds("fumbles_lost", (106,)),
    Adds("two_point_conversions", (75, 77, 104)),
)

# What a defence's line takes from the same codes. ``own`` says whether the row is of the defence itself.
DEFENCE_LINE = (
    Adds("blocked_kicks", (2, 71, 74), where="NOT own"),
    Adds("fourth_down_stops", (9,)),
    Adds("yards_against", (10, 11, 12, 13, 15, 16, 20), "stat_yards"),
    Adds("points_against", (11, 13, 16, 58), "6"),
    Adds("points_against", (56,), "6", "NOT own"),
    Adds("points_against", (70,), "3", "NOT own"),
    Adds("points_against", (72,), "1", "NOT own"),
    Adds("sacks", (20,)),
    Adds("interceptions", (25, 26)),
    Adds("touchdowns", (26, 28, 62)),
    Adds("touchdowns", (60, 64), where="own"),
    Adds("recovered_fumbles", (59,)),
    Adds("recovered_fumbles", (60,), where="own"),
    Adds("forced_fumbles", (91,), where="own"),
    Adds("safeties", (89,)),
    Adds("punt_return_touchdowns", (34, 36), where="own"),
    Adds("kickoff_return_touchdowns", (46, 48), where="own"),
    Adds("two_point_returns", (404,), where="own"),
    Adds("two_point_returns", (420,)),
)


def coded_lines(rows: DataFrame, keys: list[str], rules: tuple[Adds, ...], code: str = "stat_id", more: tuple[Column, ...] = ()) -> DataFrame:
    """A line for each key: every column of ``rules``, 0 where no row adds to it, and the aggregates of
    ``more``. Conditions and worths that are null add nothing. All come from one aggregation."""
    parts: dict[str, list[Adds]] = {}
    for rule in rules:
        parts.setdefault(rule.column, []).append(rule)
    cells = [_cell(own, code).alias(name) for name, own in parts.items()]
    return rows.groupBy(*keys).agg(*cells, *more)


def _cell(rules: list[Adds], code: str) -> Column:
    given = F.lit(None).cast("long")
    for rule in rules:
        given = F.when(F.col(code).isin(*rule.codes) & F.coalesce(F.expr(rule.where), F.lit(False)), F.expr(rule.worth).cast("long")).otherwise(given)
    reduced = F.max(given) if rules[0].longest else F.sum(given)
    return F.greatest(F.coalesce(reduced, F.lit(0)), F.lit(0)) if rules[0].longest else F.coalesce(reduced, F.lit(0))

"""Registered queries on stat lines from coded rows: game logs of players, and lines of defences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.stat_codes import DEFENCE_LINE, PLAYER_LINE, coded_lines
from tidemark.registry import query
from tidemark.sources.star import by_order, table

#: Codes that lines stand for, by the part's number. Some mean nothing to a player, some nothing at all.
CODES = (2, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 21, 22, 23, 24, 25, 26, 28, 34, 36, 46, 48, 56, 58, 59, 60, 62, 64, 69, 70, 71, 72, 73, 74, 75, 77, 89, 91, 104, 106, 111, 112, 115, 404, 420, 999)

ROWS = f"""rows AS (SELECT l_orderkey AS game, l_suppkey AS player, [{", ".join(map(str, CODES))}][1 + l_partkey % {len(CODES)}] AS stat_id, CAST(l_quantity AS BIGINT) - 5 AS stat_yards, l_linestatus = 'F' AS is_first_down, l_returnflag = 'R' AS is_qb_kneel,
  CAST(l_quantity AS BIGINT) * 2 AS yard_line_100, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS depth_of_target, c_nationkey AS offence, s_nationkey AS defence, CASE WHEN l_linenumber % 2 = 0 THEN s_nationkey ELSE c_nationkey END AS team
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def stat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stat row for each line: its supplier's, in a game of the customer's nation against the supplier's."""
    games = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    met = by_order(spark, sf_dir, lines, games)
    pieces = F.col("l_quantity").cast("long")
    return met.select(
        F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), F.element_at(F.array(*map(F.lit, CODES)), (1 + F.col("l_partkey") % len(CODES)).cast("int")).alias("stat_id"), (pieces - 5).alias("stat_yards"),
        (F.col("l_linestatus") == "F").alias("is_first_down"), (F.col("l_returnflag") == "R").alias("is_qb_kneel"), (pieces * 2).alias("yard_line_100"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("depth_of_target"),
        F.col("c_nationkey").alias("offence"), F.col("s_nationkey").alias("defence"), F.when(F.col("l_linenumber") % 2 == 0, F.col("s_nationkey")).otherwise(F.col("c_nationkey")).alias("team"),
    )


@query(f"""WITH {ROWS}, n AS (SELECT game, count(*) AS plays FROM rows GROUP BY game), k AS (SELECT game, player, any_value(offence) AS opponent, count(*) AS snaps,
count(*) FILTER (WHERE stat_id IN (10, 11)) AS rushing_attempts, coalesce(sum(stat_yards) FILTER (WHERE stat_id BETWEEN 10 AND 13), 0) AS rushing_yards, coalesce(sum(stat_yards) FILTER (WHERE stat_id BETWEEN 10 AND 13 AND NOT is_qb_kneel), 0) AS rushing_yards_excluding_kneels, count(*) FILTER (WHERE stat_id IN (11, 13)) AS rushing_touchdowns,
count(*) FILTER (WHERE stat_id IN (10, 11) AND is_first_down) AS rushing_first_downs, count(*) FILTER (WHERE stat_id = 10 AND is_first_down) AS rushing_first_downs_excluding_touchdowns, greatest(coalesce(max(stat_yards) FILTER (WHERE stat_id BETWEEN 10 AND 13), 0), 0) AS longest_rush,
count(*) FILTER (WHERE stat_id IN (10, 11) AND yard_line_100 <= 20) AS rush_attempts_redzone, count(*) FILTER (WHERE stat_id IN (10, 11) AND yard_line_100 <= 5) AS rush_attempts_goal_line,
count(*) FILTER (WHERE stat_id IN (14, 15, 16, 19)) AS passing_attempts, count(*) FILTER (WHERE stat_id IN (15, 16)) AS passing_completions, coalesce(sum(stat_yards) FILTER (WHERE stat_id IN (15, 16)), 0) AS passing_yards, count(*) FILTER (WHERE stat_id = 16) AS passing_touchdowns, count(*) FILTER (WHERE stat_id = 19) AS passing_interceptions,
coalesce(sum(stat_yards) FILTER (WHERE stat_id IN (111, 112)), 0) AS passing_air_yards, count(*) FILTER (WHERE stat_id IN (21, 22)) AS receptions, coalesce(sum(stat_yards) FILTER (WHERE stat_id BETWEEN 21 AND 24), 0) AS receiving_yards, count(*) FILTER (WHERE stat_id IN (22, 24)) AS receiving_touchdowns,
count(*) FILTER (WHERE stat_id IN (21, 22) AND is_first_down) AS receiving_first_downs, count(*) FILTER (WHERE stat_id = 21 AND is_first_down) AS receiving_first_downs_excluding_touchdowns, count(*) FILTER (WHERE stat_id IN (21, 22) AND stat_yards >= 15) AS receiving_yards_15_plus_count, greatest(coalesce(max(stat_yards) FILTER (WHERE stat_id IN (21, 22)), 0), 0) AS longest_reception,
count(*) FILTER (WHERE stat_id = 115) AS targets, coalesce(sum(depth_of_target) FILTER (WHERE stat_id = 115), 0) AS targeted_air_yards, count(*) FILTER (WHERE stat_id = 115 AND yard_line_100 <= 20) AS redzone_targets,
count(*) FILTER (WHERE stat_id IN (69, 70)) AS field_goal_attempts, count(*) FILTER (WHERE stat_id = 70) AS field_goals_made, coalesce(sum(greatest(stat_yards, 30)) FILTER (WHERE stat_id = 70), 0) AS field_goal_yards, count(*) FILTER (WHERE stat_id = 70 AND stat_yards < 20) AS field_goals_made_0_19_yards, count(*) FILTER (WHERE stat_id = 70 AND stat_yards BETWEEN 20 AND 29) AS field_goals_made_20_29_yards,
count(*) FILTER (WHERE stat_id = 70 AND stat_yards BETWEEN 30 AND 39) AS field_goals_made_30_39_yards, count(*) FILTER (WHERE stat_id = 70 AND stat_yards BETWEEN 40 AND 49) AS field_goals_made_40_49_yards, count(*) FILTER (WHERE stat_id = 70 AND stat_yards >= 50) AS field_goals_made_50_plus_yards, count(*) FILTER (WHERE stat_id IN (72, 73)) AS extra_point_attempts, count(*) FILTER (WHERE stat_id = 72) AS extra_points_made,
count(*) FILTER (WHERE stat_id IN (34, 36)) AS punt_return_touchdowns, count(*) FILTER (WHERE stat_id IN (46, 48)) AS kickoff_return_touchdowns, count(*) FILTER (WHERE stat_id IN (56, 58, 60, 62)) AS fumble_return_touchdowns, count(*) FILTER (WHERE stat_id = 106) AS fumbles_lost, count(*) FILTER (WHERE stat_id IN (75, 77, 104)) AS two_point_conversions
FROM rows GROUP BY game, player) SELECT k.* REPLACE (CAST(opponent AS INTEGER) AS opponent), plays, snaps * 2 >= plays AS active, round(snaps / CAST(plays AS DOUBLE), 4) AS snap_share FROM k JOIN n USING (game)""")
def player_game_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's line of each game with its snaps, their share of the game's plays, and the opponent."""
    rows = stat_rows(spark, sf_dir)
    around = (F.any_value("offence").cast("int").alias("opponent"), F.count("*").alias("snaps"))
    logs = coded_lines(rows, ["game", "player"], PLAYER_LINE, more=around).withColumn("plays", F.sum("snaps").over(Window.partitionBy("game")))
    return logs.withColumns({"active": F.col("snaps") * 2 >= F.col("plays"), "snap_share": F.round(F.col("snaps") / F.col("plays"), 4)})


@query(f"""WITH {ROWS} SELECT game, CAST(defence AS INTEGER) AS defence, count(*) FILTER (WHERE stat_id IN (2, 71, 74) AND team <> defence) AS blocked_kicks, count(*) FILTER (WHERE stat_id = 9) AS fourth_down_stops, coalesce(sum(stat_yards) FILTER (WHERE stat_id IN (10, 11, 12, 13, 15, 16, 20)), 0) AS yards_against,
CAST(coalesce(sum(CASE WHEN stat_id IN (11, 13, 16, 58) THEN 6 WHEN stat_id = 56 AND team <> defence THEN 6 WHEN stat_id = 70 AND team <> defence THEN 3 WHEN stat_id = 72 AND team <> defence THEN 1 ELSE 0 END), 0) AS BIGINT) AS points_against, count(*) FILTER (WHERE stat_id = 20) AS sacks,
count(*) FILTER (WHERE stat_id IN (25, 26)) AS interceptions, count(*) FILTER (WHERE stat_id IN (26, 28, 62) OR (stat_id IN (60, 64) AND team = defence)) AS touchdowns, count(*) FILTER (WHERE stat_id = 59 OR (stat_id = 60 AND team = defence)) AS recovered_fumbles, count(*) FILTER (WHERE stat_id = 91 AND team = defence) AS forced_fumbles,
count(*) FILTER (WHERE stat_id = 89) AS safeties, count(*) FILTER (WHERE stat_id IN (34, 36) AND team = defence) AS punt_return_touchdowns, count(*) FILTER (WHERE stat_id IN (46, 48) AND team = defence) AS kickoff_return_touchdowns, count(*) FILTER (WHERE stat_id = 420 OR (stat_id = 404 AND team = defence)) AS two_point_returns
FROM rows WHERE defence <> offence GROUP BY game, defence""")
def defence_game_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each defence in each game, from the same rows by codes with other meanings."""
    rows = stat_rows(spark, sf_dir).filter("defence <> offence").withColumns({"own": F.col("team") == F.col("defence"), "defence": F.col("defence").cast("int")})
    return coded_lines(rows, ["game", "defence"], DEFENCE_LINE)

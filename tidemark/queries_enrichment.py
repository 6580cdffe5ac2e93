"""Registered queries on enriched plays and on snaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.operators.enrichment import enriched, snap_counts
from tidemark.registry import query
from tidemark.sources.star import by_order, table

TRACKED = ("play_type_pass", "play_type_rush", "play_type_punt", "play_type_kickoff", "play_type_field_goal", "play_type_sack", "play_type_unknown", "play_type_two_point_conversion", "other")
LEAGUE = ("PASS", "RUSH", "PUNT", "XP_KICK", "TIMEOUT", "INTERCEPTION", "END_GAME", "PAT2")
TEXTS = ("deep pass", "to the left. No Play.", "TWO-POINT CONVERSION ATTEMPT. Penalty, enforced between downs", "QB kneels", "spiked the ball", "short pass")


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PLAYS = f"""games AS (SELECT o_orderkey AS game, c_nationkey AS home, CASE WHEN o_orderkey % 50 <> 0 THEN (c_nationkey + 1 + o_orderkey % 24) % 25 END AS away FROM orders JOIN customer ON o_custkey = c_custkey),
plays AS (SELECT game, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS play, l_suppkey, l_partkey, home, away, CASE WHEN l_partkey % 11 <> 0 THEN CASE WHEN l_linenumber % 2 = 1 THEN home ELSE away END END AS possession,
  {listed(TEXTS)}[1 + l_partkey % 6] AS description, CASE WHEN l_suppkey % 10 < 9 THEN {listed(TRACKED)}[1 + l_suppkey % 10] END AS tracked_type, CASE WHEN l_partkey % 9 < 8 THEN {listed(LEAGUE)}[1 + l_partkey % 9] END AS league_type,
  l_linenumber AS down, CAST(l_quantity AS BIGINT) % 12 AS to_go, CAST(l_quantity AS BIGINT) % 9 AS gained, CASE WHEN l_linenumber < 7 THEN l_linenumber // 3 END AS drive, l_returnflag = 'A' AS is_pass, l_returnflag = 'R' AS is_rush,
  CAST(l_quantity AS BIGINT) * 2 AS yard_line, l_partkey % 21 - 10 AS margin, l_tax * 12 AS win_probability FROM lineitem JOIN games ON l_orderkey = game),
teams AS (SELECT *, CASE WHEN away IS NOT NULL THEN possession END AS offense, CASE WHEN away IS NOT NULL AND possession IS NOT NULL THEN CASE WHEN possession = home THEN away ELSE home END END AS defense,
  CASE WHEN description LIKE '%No Play%' THEN 'NOPL' WHEN description LIKE '%enforced between downs%' THEN 'CONV' ELSE coalesce(CASE tracked_type WHEN 'play_type_pass' THEN 'PASS' WHEN 'play_type_sack' THEN 'PASS' WHEN 'play_type_rush' THEN 'RUSH' WHEN 'play_type_punt' THEN 'PUNT' WHEN 'play_type_kickoff' THEN 'KOFF' WHEN 'play_type_field_goal' THEN 'FGXP'
    WHEN 'play_type_unknown' THEN 'NOPL' WHEN 'play_type_two_point_conversion' THEN 'CONV' END, CASE league_type WHEN 'PASS' THEN 'PASS' WHEN 'INTERCEPTION' THEN 'PASS' WHEN 'RUSH' THEN 'RUSH' WHEN 'PUNT' THEN 'PUNT' WHEN 'XP_KICK' THEN 'FGXP' WHEN 'PAT2' THEN 'CONV' WHEN 'TIMEOUT' THEN 'NOPL' WHEN 'END_GAME' THEN 'NOPL' END) END AS play_type,
  coalesce(league_type = 'RUSH' AND description LIKE '%kneel%', false) AS is_qb_kneel, coalesce(league_type = 'PASS' AND description LIKE '%spike%', false) AS is_qb_spike,
  CASE WHEN to_go <> 0 THEN CASE WHEN down = 1 THEN gained >= to_go * 0.4 WHEN down = 2 THEN gained >= to_go * 0.6 WHEN down IN (3, 4) THEN gained >= to_go END END AS is_success FROM plays),
done AS (SELECT *, CASE WHEN drive IS NOT NULL THEN count(*) FILTER (WHERE coalesce(league_type, '') NOT IN ('TIMEOUT', 'END_GAME') AND coalesce(play_type, '') NOT IN ('KOFF', 'PUNT', 'FGXP', 'CONV') AND NOT (coalesce(play_type, '') = 'NOPL' AND NOT is_pass AND NOT is_rush)) OVER (PARTITION BY game, drive) END AS drive_play_count FROM teams)"""


def pick(values: tuple[str, ...], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def plays_of_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as plays of their order's game: of the customer's nation against another one. They are
    dealt by the game."""
    games = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    away = F.when(F.col("o_orderkey") % 50 != 0, ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int"))
    games = games.select("o_orderkey", F.col("c_nationkey").cast("int").alias("home"), away.alias("away"))
    pieces, part, number = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_linenumber")
    lines = by_order(spark, sf_dir, table(spark, sf_dir, "lineitem"), games)
    return lines.select(
        F.col("o_orderkey").alias("game"), "home", "away", (F.col("l_orderkey") * 10_000_000 + number * 1_000_000 + part * 100 + F.col("l_suppkey") % 100).alias("play"), "l_suppkey", "l_partkey", F.when(part % 11 != 0, F.when(number % 2 == 1, F.col("home")).otherwise(F.col("away"))).alias("possession"),
        pick(TEXTS, part % 6).alias("description"), F.when(F.col("l_suppkey") % 10 < 9, pick(TRACKED, F.col("l_suppkey") % 10)).alias("tracked_type"), F.when(part % 9 < 8, pick(LEAGUE, part % 9)).alias("league_type"),
        number.alias("down"), (pieces % 12).alias("to_go"), (pieces % 9).alias("gained"), F.when(number < 7, F.floor(number / 3).cast("int")).alias("drive"), (F.col("l_returnflag") == "A").alias("is_pass"), (F.col("l_returnflag") == "R").alias("is_rush"),
        (pieces * 2).alias("yard_line"), (part % 21 - 10).alias("margin"), (F.col("l_tax") * 12).alias("win_probability"),
    )


@query(f"WITH {PLAYS} SELECT play, CAST(offense AS INTEGER) AS offense, CAST(defense AS INTEGER) AS defense, play_type, is_qb_kneel, is_qb_spike, CAST(is_success AS INTEGER) AS is_success, drive_play_count FROM done")
def enriched_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(plays_of_games(spark, sf_dir), None, "game").select("play", "offense", "defense", "play_type", "is_qb_kneel", "is_qb_spike", F.col("is_success").cast("int").alias("is_success"), "drive_play_count")


@query(f"""WITH {PLAYS}, live AS (SELECT * FROM done WHERE play_type <> 'NOPL'), snaps AS (SELECT DISTINCT a.game, a.play, b.l_suppkey AS player, CASE WHEN b.l_suppkey % 2 = 0 THEN a.home ELSE a.away END AS team FROM plays a JOIN plays b ON a.game = b.game WHERE (a.l_partkey + b.l_suppkey) % 3 <> 0),
marks AS (SELECT s.game, s.player, s.team, play_type IN ('PASS', 'RUSH') AND team = offense AS off, play_type IN ('PASS', 'RUSH') AND team = defense AS def, play_type IN ('PUNT', 'FGXP', 'KOFF', 'ONSD') AS special, l.* EXCLUDE (game) FROM snaps s JOIN live l ON l.game = s.game AND l.play = s.play),
own AS (SELECT game, player, team, count(*) FILTER (WHERE off) AS off, count(*) FILTER (WHERE def) AS def, count(*) FILTER (WHERE special) AS special, count(*) FILTER (WHERE off AND play_type = 'PASS') AS pass, count(*) FILTER (WHERE off AND play_type = 'RUSH') AS rush, count(*) FILTER (WHERE off AND yard_line <= 20) AS inside_twenty, count(*) FILTER (WHERE off AND yard_line <= 10) AS inside_ten,
  count(*) FILTER (WHERE off AND yard_line <= 5) AS inside_five, count(*) FILTER (WHERE off AND margin > 0) AS leading, count(*) FILTER (WHERE off AND margin < 0) AS trailing, count(*) FILTER (WHERE off AND win_probability > 0.2 AND win_probability < 0.8) AS neutral, count(*) FILTER (WHERE off AND win_probability < 0.2) AS low_probability,
  count(*) FILTER (WHERE off AND win_probability > 0.2 AND win_probability < 0.8 AND to_go <= 3) AS neutral_short, count(*) FILTER (WHERE off AND win_probability > 0.2 AND win_probability < 0.8 AND to_go >= 7) AS neutral_long, count(*) FILTER (WHERE off AND win_probability > 0.2 AND win_probability < 0.8 AND down <= 2) AS neutral_early_down,
  count(*) FILTER (WHERE off AND win_probability > 0.2 AND win_probability < 0.8 AND down > 2) AS neutral_late_down FROM marks GROUP BY ALL),
t AS (SELECT game, team, count(*) FILTER (WHERE play_type IN ('PASS', 'RUSH') AND team = offense) AS o, count(*) FILTER (WHERE play_type IN ('PASS', 'RUSH') AND team = defense) AS d FROM (SELECT *, unnest([offense, defense]) AS team FROM live) GROUP BY ALL)
SELECT own.* REPLACE (CAST(team AS INTEGER) AS team), round(off / CAST(nullif(o, 0) AS DOUBLE), 4) AS off_share, round(def / CAST(nullif(d, 0) AS DOUBLE), 4) AS def_share FROM own LEFT JOIN t USING (game, team)""")
def snap_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snaps of two in three pairs of a play and a supplier of its game, by situation."""
    plays = enriched(plays_of_games(spark, sf_dir), None, "game", ("teams", "play_types"))
    # Lines can share a play; each of them tells who was there. A game has a few plays and players.
    # Both windows run over one order.
    whole = Window.partitionBy("game").orderBy("play").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.collect_set(F.struct("l_partkey", "home", "away")).over(Window.partitionBy("game", "play"))
    plays = plays.withColumns({"_told": told, "_players": F.collect_set("l_suppkey").over(whole)})
    # Players are distinct, so only the teams told for one of them can repeat; distinct pairs of a long list would be compared two by two.
    teams = lambda p: F.array_distinct(F.transform(F.filter("_told", lambda t: (t["l_partkey"] + p) % 3 != 0), lambda t: F.when(p % 2 == 0, t["home"]).otherwise(t["away"])))
    there = lambda p: F.transform(teams(p), lambda team: F.struct(p.alias("player"), team.alias("team")))
    on_field = F.when(F.col("play").isNotNull(), F.flatten(F.transform("_players", there)))
    return snap_counts(plays.withColumn("on_field", on_field), "game")

"""Registered queries on rate denominators of teams, roles and participation, all in the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.model import Filter, Output, ViewColumn, ViewRequest
from tidemark.plans.view import plan_view
from tidemark.registry import query
from tidemark.sources.star import star_catalog

TEAM_UNITS = ("team_drive", "team_half", "team_pass_play", "team_play", "team_quarter", "team_rush_play", "team_series")
ROLE_UNITS = ("player_rush_attempt", "player_pass_attempt", "player_target", "player_catchable_target", "player_deep_target", "player_catchable_deep_target", "player_reception", "player_touch", "player_opportunity")
FIELD_UNITS = ("player_pass_play", "player_play", "player_route", "player_rush_play")


def rates(units: tuple[str, ...], filters: tuple[Filter, ...] = ()) -> tuple[ViewColumn, ...]:
    return tuple(ViewColumn("revenue", Output("rate", unit), filters) for unit in units)


def quotients(units: tuple[str, ...]) -> str:
    """Quotients rounded by their decimal digits, halves up."""
    return ", ".join(f"CAST(round(CAST(CAST(total / nullif({unit}, 0) AS VARCHAR) AS DECIMAL(36,14)), 4) AS DOUBLE) AS revenue_{i}" for i, unit in enumerate(units))


TEAM_COUNTS = """count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS team_play, count(*) FILTER (WHERE l_returnflag = 'A') AS team_pass_play, count(*) FILTER (WHERE l_returnflag = 'R') AS team_rush_play,
count(DISTINCT l_linestatus = 'F') FILTER (WHERE l_returnflag IN ('A', 'R')) AS team_half, count(DISTINCT l_linenumber % 4) FILTER (WHERE l_returnflag IN ('A', 'R')) AS team_quarter, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag IN ('A', 'R')) AS team_drive,
count(DISTINCT (o_orderkey, l_suppkey)) FILTER (WHERE l_returnflag IN ('A', 'R')) AS team_series"""


@query(f"""WITH $LINES, g AS (SELECT c_nationkey AS team, year, week, {TEAM_COUNTS} FROM lines WHERE c_nationkey IS NOT NULL AND year IN (1995, 1996) GROUP BY ALL),
a AS (SELECT DISTINCT o_custkey AS subject, year, week, c_nationkey AS team FROM lines WHERE year IN (1995, 1996)), d AS (SELECT subject, year, {", ".join(f"sum({u}) AS {u}" for u in TEAM_UNITS)} FROM a JOIN g USING (team, year, week) GROUP BY ALL),
m AS (SELECT o_custkey AS subject, year, CAST(sum(price) AS DOUBLE) AS total FROM lines WHERE year IN (1995, 1996) AND l_returnflag = 'A' GROUP BY ALL),
s AS (SELECT c_custkey AS subject, CAST(year AS INTEGER) AS year, c_name, c_mktsegment FROM customer, (SELECT unnest([1995, 1996]) AS year))
SELECT s.*, {quotients(TEAM_UNITS)} FROM s LEFT JOIN m USING (subject, year) LEFT JOIN d USING (subject, year)""")
def view_rates_by_team_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's passing by what the player's team did in the weeks that the player was active in."""
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(rates(TEAM_UNITS, (Filter("l_returnflag", "=", "A"),)), axes=("year",), years=(1995, 1996), limit=None))


@query(f"""WITH $LINES, g AS (SELECT c_nationkey AS subject, year, week, {TEAM_COUNTS} FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL), d AS (SELECT subject, {", ".join(f"sum({u}) AS {u}" for u in TEAM_UNITS)} FROM g GROUP BY ALL),
m AS (SELECT c_nationkey AS subject, CAST(sum(price) AS DOUBLE) AS total FROM lines GROUP BY ALL)
SELECT n_nationkey AS subject, n_name, r_name, {quotients(TEAM_UNITS)} FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN m ON m.subject = n_nationkey LEFT JOIN d ON d.subject = n_nationkey""")
def view_team_rates_by_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(rates(TEAM_UNITS), grain="team", limit=None))


ROLE_CREDITS = """u AS (SELECT o_custkey AS subject, year, l_returnflag = 'R' AS rush, l_returnflag = 'A' AS pass, false AS target, false AS caught, false AS deep, false AS kept FROM lines
UNION ALL SELECT l_suppkey, year, false, false, l_returnflag = 'A', l_returnflag = 'A' AND l_linestatus = 'F', l_returnflag = 'A' AND qty BETWEEN 20 AND 99, l_returnflag = 'A' AND l_linestatus = 'F' AND disc > 0 FROM lines)"""
ROLE_COUNTS = """count(*) FILTER (WHERE rush) AS player_rush_attempt, count(*) FILTER (WHERE pass) AS player_pass_attempt, count(*) FILTER (WHERE target) AS player_target, count(*) FILTER (WHERE caught) AS player_catchable_target, count(*) FILTER (WHERE deep) AS player_deep_target,
count(*) FILTER (WHERE deep AND caught) AS player_catchable_deep_target, count(*) FILTER (WHERE kept) AS player_reception, count(*) FILTER (WHERE rush OR caught) AS player_touch, count(*) FILTER (WHERE rush OR target) AS player_opportunity"""


@query(f"""WITH $LINES, {ROLE_CREDITS}, d AS (SELECT subject, year, {ROLE_COUNTS} FROM u WHERE year IN (1996, 1997) GROUP BY ALL), m AS (SELECT o_custkey AS subject, year, CAST(sum(price) AS DOUBLE) AS total FROM lines WHERE year IN (1996, 1997) GROUP BY ALL),
s AS (SELECT c_custkey AS subject, CAST(year AS INTEGER) AS year, c_name, c_mktsegment FROM customer, (SELECT unnest([1996, 1997]) AS year))
SELECT s.*, {quotients(ROLE_UNITS)} FROM s LEFT JOIN m USING (subject, year) LEFT JOIN d USING (subject, year)""")
def view_rates_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by attempts, targets, receptions, touches and opportunities, in whatever role they came."""
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(rates(ROLE_UNITS), axes=("year",), years=(1996, 1997), limit=None))


@query(f"""WITH $LINES, f AS (SELECT o_orderkey, l_suppkey AS subject, year, min(l_linenumber) AS since FROM lines WHERE year IN (1994, 1995) GROUP BY ALL),
d AS (SELECT f.subject, f.year, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS player_play, count(*) FILTER (WHERE l_returnflag = 'A') AS player_pass_play, count(*) FILTER (WHERE l_returnflag = 'R') AS player_rush_play, count(*) FILTER (WHERE l_returnflag = 'A' AND qty > 5) AS player_route
  FROM f JOIN lines l ON l.o_orderkey = f.o_orderkey AND l.l_linenumber >= since GROUP BY ALL), m AS (SELECT l_suppkey AS subject, year, CAST(sum(price) AS DOUBLE) AS total FROM lines WHERE year IN (1994, 1995) AND l_returnflag = 'A' GROUP BY ALL),
s AS (SELECT s_suppkey AS subject, CAST(year AS INTEGER) AS year, s_name FROM supplier, (SELECT unnest([1994, 1995]) AS year))
SELECT s.*, {quotients(FIELD_UNITS)} FROM s LEFT JOIN m USING (subject, year) LEFT JOIN d USING (subject, year)""")
def view_rates_by_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receiver's catches by the plays and routes of its games that it took part in; the SQL expands plays by members."""
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(rates(FIELD_UNITS, (Filter("l_returnflag", "=", "A"),)), grain="receiver", axes=("year",), years=(1994, 1995), limit=None))

"""Registered queries on the measures of plays, of players, receivers and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.model import Output, ViewColumn, ViewRequest
from tidemark.plans.view import plan_view
from tidemark.registry import query
from tidemark.sources.star import play_measures, star_catalog

#: Counts, sums and largest gains as SQL over lines; quotients follow from them below.
SUMS = {
    "pass_attempts": "count(*) FILTER (WHERE a)", "pass_completions": "count(*) FILTER (WHERE c)", "pass_yards": "sum(qty) FILTER (WHERE c)", "pass_touchdowns": "count(*) FILTER (WHERE c AND qty >= 46)", "interceptions": "count(*) FILTER (WHERE a AND l_linestatus = 'O' AND l_tax >= 0.07)",
    "sacks": "count(*) FILTER (WHERE a AND l_linestatus = 'O' AND l_tax < 0.01)", "pass_air_yards": "sum(l_linenumber) FILTER (WHERE a)", "completed_air_yards": "sum(l_linenumber) FILTER (WHERE c)", "yards_after_catch": "sum(qty - l_linenumber) FILTER (WHERE c)", "deep_attempts": "count(*) FILTER (WHERE a AND qty >= 20)",
    "deep_completions": "count(*) FILTER (WHERE c AND qty >= 20)", "pass_first_downs": "count(*) FILTER (WHERE c AND qty >= 10)", "longest_pass": "max(qty) FILTER (WHERE c)", "rush_attempts": "count(*) FILTER (WHERE r)", "rush_yards": "sum(qty) FILTER (WHERE r)", "rush_touchdowns": "count(*) FILTER (WHERE r AND qty >= 46)",
    "rush_first_downs": "count(*) FILTER (WHERE r AND qty >= 10)", "stuffed_rushes": "count(*) FILTER (WHERE r AND qty < 3)", "explosive_rushes": "count(*) FILTER (WHERE r AND qty >= 40)", "longest_rush": "max(qty) FILTER (WHERE r)", "plays": "count(*) FILTER (WHERE a OR r)", "scrimmage_yards": "sum(qty) FILTER (WHERE c OR r)",
    "touchdowns": "count(*) FILTER (WHERE (c OR r) AND qty >= 46)", "first_downs": "count(*) FILTER (WHERE (c OR r) AND qty >= 10)", "explosive_plays": "count(*) FILTER (WHERE (c OR r) AND qty >= 40)",
}
QUOTIENTS = {
    "completion_pct": "100.0 * pass_completions / pass_attempts", "pass_yards_per_attempt": "pass_yards / pass_attempts", "pass_yards_per_completion": "pass_yards / pass_completions", "pass_touchdown_pct": "100.0 * pass_touchdowns / pass_attempts", "interception_pct": "100.0 * interceptions / pass_attempts",
    "sack_pct": "100.0 * sacks / pass_attempts", "air_yards_per_attempt": "pass_air_yards / pass_attempts", "air_conversion": "pass_yards / pass_air_yards", "yards_after_catch_share": "100.0 * yards_after_catch / pass_yards", "deep_attempt_pct": "100.0 * deep_attempts / pass_attempts",
    "deep_completion_pct": "100.0 * deep_completions / deep_attempts", "pass_first_down_pct": "100.0 * pass_first_downs / pass_attempts", "rush_yards_per_attempt": "rush_yards / rush_attempts", "rush_first_down_pct": "100.0 * rush_first_downs / rush_attempts", "stuffed_pct": "100.0 * stuffed_rushes / rush_attempts",
    "explosive_rush_pct": "100.0 * explosive_rushes / rush_attempts", "yards_per_play": "scrimmage_yards / plays", "first_down_pct": "100.0 * first_downs / plays", "explosive_pct": "100.0 * explosive_plays / plays", "touchdown_pct": "100.0 * touchdowns / plays",
}


def measured(subject: str, keys: str, where: str) -> str:
    """A CTE ``m`` of all measures, each under the name that a view gives it."""
    kinds = "l_returnflag = 'A' AS a, l_returnflag = 'A' AND l_linestatus = 'F' AS c, l_returnflag = 'R' AS r"
    sums = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in SUMS.items())
    rounded = ", ".join(f"CAST(round(CAST(CAST({e.replace(' / ', ' / nullif(')}, 0) AS VARCHAR) AS DECIMAL(36,14)), 4) AS DOUBLE) AS {n}_0" for n, e in QUOTIENTS.items())
    return f"f AS (SELECT *, {subject} AS subject, {kinds} FROM lines {where}), k AS (SELECT {keys}, {sums} FROM f WHERE subject IS NOT NULL GROUP BY ALL), m AS (SELECT {keys}, {', '.join(f'{n} AS {n}_0' for n in SUMS)}, {rounded} FROM k)"


def all_measures() -> tuple[ViewColumn, ...]:
    return tuple(ViewColumn(m.name) for m in play_measures())


@query(f"""WITH $LINES, {measured("o_custkey", "subject, year", "WHERE year IN (1995, 1996)")} SELECT c_custkey AS subject, CAST(y.year AS INTEGER) AS year, c_name, c_mktsegment, m.* EXCLUDE (subject, year) FROM customer CROSS JOIN (SELECT unnest([1995, 1996]) AS year) y LEFT JOIN m ON m.subject = c_custkey AND m.year = y.year""")
def view_player_play_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of plays for passers and rushers by year, from one aggregation."""
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(all_measures(), axes=("year",), years=(1995, 1996), limit=None))


@query(f"""WITH $LINES, {measured("l_suppkey", "subject", "")} SELECT s_suppkey AS subject, s_name, m.* EXCLUDE (subject) FROM supplier LEFT JOIN m ON m.subject = s_suppkey""")
def view_receiver_play_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(all_measures(), grain="receiver", limit=None))


@query(f"""WITH $LINES, {measured("c_nationkey", "subject, year, week", "WHERE year = 1996")}, w AS (SELECT DISTINCT week FROM lines WHERE year = 1996)
SELECT n_nationkey AS subject, CAST(1996 AS INTEGER) AS year, w.week, n_name, r_name, m.* EXCLUDE (subject, year, week) FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN w LEFT JOIN m ON m.subject = n_nationkey AND m.week = w.week""")
def view_team_week_play_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(all_measures(), grain="team", axes=("year", "week"), years=(1996,), limit=None))


@query("""WITH $LINES, g AS (SELECT o_custkey AS subject, year, o_orderkey, CAST(sum(price) AS DOUBLE) AS v, CAST(count(l_linenumber) AS DOUBLE) AS n FROM lines WHERE year IN (1996, 1997) GROUP BY ALL),
m AS (SELECT subject, year, max(v) AS revenue_0, min(v) AS revenue_1, max(n) AS lines_0 FROM g GROUP BY ALL) SELECT c_custkey AS subject, CAST(y.year AS INTEGER) AS year, c_name, c_mktsegment, revenue_0, revenue_1, lines_0 FROM customer CROSS JOIN (SELECT unnest([1996, 1997]) AS year) y LEFT JOIN m ON m.subject = c_custkey AND m.year = y.year""")
def view_best_and_worst_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (ViewColumn("revenue", Output("most", "game")), ViewColumn("revenue", Output("least", "game")), ViewColumn("lines", Output("most", "game")))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(columns, axes=("year",), years=(1996, 1997), limit=None))

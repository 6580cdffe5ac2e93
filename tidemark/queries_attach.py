"""Registered queries on columns of other sources, computed columns and cells with bounds of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import joins
from tidemark.plans.attach import Attached, Bridge, Source
from tidemark.plans.model import Catalog, Filter, ViewColumn, ViewRequest
from tidemark.plans.view import plan_view
from tidemark.registry import query
from tidemark.sources.star import order_lines, star_catalog, table


def sourced_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star with a source of each grain: a customer's own row and years, a nation's suppliers and
    their years. A customer's team in a season is the nation that most lines came from; a team's
    opponent in a week is the other nation that most lines of its customers came from."""
    catalog = star_catalog(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("home"))
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    came = order_lines(spark, sf_dir).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    met = came.join(customer, F.col("o_custkey") == F.col("c_custkey")).filter("home <> s_nationkey")
    catalog.attachable(Source("account", table(spark, sf_dir, "customer"), "player", {"player": "c_custkey"}, leads=True))
    catalog.attachable(Source("order_year", orders.groupBy("o_custkey", "y").agg(F.count("*").alias("placed"), F.max("o_totalprice").alias("dearest")), "player_year", {"player": "o_custkey", "year": "y"}, leads=True))
    catalog.attachable(Source("suppliers", supplier.groupBy("s_nationkey").agg(F.count("*").alias("many"), F.max("s_acctbal").alias("richest")), "team", {"team": "s_nationkey"}))
    catalog.attachable(Source("supply_year", came.groupBy("s_nationkey", F.col("year").alias("y")).agg(F.count("*").alias("sent"), F.countDistinct("o_orderkey").alias("served")), "team_year", {"team": "s_nationkey", "year": "y"}))
    opponent = joins.mode_per_key(met, ["home", "year", "week"], "s_nationkey").select(F.col("home").alias("team"), "year", "week", F.col("s_nationkey").alias("to_team"))
    catalog.bridges |= {
        "current_team": Bridge(customer.select(F.col("c_custkey").alias("player"), F.col("home").alias("to_team")), ("player",)),
        "season_team": Bridge(joins.mode_per_key(came, ["o_custkey", "year"], "s_nationkey").select(F.col("o_custkey").alias("player"), "year", F.col("s_nationkey").alias("to_team")), ("player", "year")),
        "opponent": Bridge(opponent, ("team", "year", "week")),
        "next_opponent": Bridge(opponent.withColumn("week", F.col("week") - 1), ("team", "year", "week")),
    }
    return catalog


_SOURCES = """$LINES, came AS (SELECT lines.*, s_nationkey FROM lines JOIN supplier ON l_suppkey = s_suppkey),
order_year AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS placed, max(o_totalprice) AS dearest FROM orders GROUP BY ALL),
suppliers AS (SELECT s_nationkey AS team, count(*) AS many, max(s_acctbal) AS richest FROM supplier GROUP BY ALL),
supply_year AS (SELECT s_nationkey AS team, year AS y, count(*) AS sent, count(DISTINCT o_orderkey) AS served FROM came GROUP BY ALL),
by_season AS (SELECT o_custkey AS player, year, s_nationkey AS team, count(*) AS n FROM came GROUP BY ALL), season_team AS (SELECT * FROM by_season QUALIFY row_number() OVER (PARTITION BY player, year ORDER BY n DESC, team) = 1),
by_week AS (SELECT c_nationkey AS home, year, week, s_nationkey AS other, count(*) AS n FROM came WHERE c_nationkey <> s_nationkey GROUP BY ALL), opponent AS (SELECT * FROM by_week QUALIFY row_number() OVER (PARTITION BY home, year, week ORDER BY n DESC, other) = 1),
nations AS (SELECT n_nationkey AS subject, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_PLAYER_YEARS = "SELECT c_custkey AS subject, CAST(y AS INTEGER) AS year, c_name, c_mktsegment FROM customer, (SELECT unnest([1995, 1996]) AS y)"


@query(f"""WITH {_SOURCES} SELECT c_custkey AS subject, c_name, c_mktsegment, c_acctbal AS balance, placed, many FROM customer LEFT JOIN order_year ON o_custkey = c_custkey AND y = 1996 AND placed >= 2 LEFT JOIN suppliers ON team = c_nationkey""")
def attach_to_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own row, one fixed year with a bound inside the join, and the current team."""
    within = (Filter("y", "=", 1996), Filter("placed", ">=", 2))
    attached = (Attached("balance", "account", "c_acctbal"), Attached("placed", "order_year", "placed", within=within), Attached("many", "suppliers", "many"))
    return plan_view(sourced_catalog(spark, sf_dir), ViewRequest((), attached=attached, limit=None))


@query(f"""WITH {_SOURCES}, s AS ({_PLAYER_YEARS}), m AS (SELECT o_custkey AS subject, year, CAST(sum(price) AS DOUBLE) AS revenue_0 FROM lines WHERE year IN (1995, 1996) GROUP BY ALL)
SELECT s.*, revenue_0, o.placed, p.placed AS placed_before, sent, richest FROM s LEFT JOIN m USING (subject, year) LEFT JOIN order_year o ON o.o_custkey = subject AND o.y = s.year LEFT JOIN order_year p ON p.o_custkey = subject AND p.y = s.year - 1
LEFT JOIN season_team t ON t.player = subject AND t.year = s.year LEFT JOIN supply_year u ON u.team = t.team AND u.y = s.year LEFT JOIN suppliers v ON v.team = t.team""")
def attach_to_player_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year itself, the year before, and the season's team with its year."""
    attached = (
        Attached("placed", "order_year", "placed"), Attached("placed_before", "order_year", "placed", year_offset=-1),
        Attached("sent", "supply_year", "sent"), Attached("richest", "suppliers", "richest"),
    )
    return plan_view(sourced_catalog(spark, sf_dir), ViewRequest((ViewColumn("revenue"),), axes=("year",), years=(1995, 1996), attached=attached, limit=None))


@query(f"""WITH {_SOURCES}, s AS ({_PLAYER_YEARS}) SELECT s.*, placed, sent FROM s JOIN order_year o ON o.o_custkey = subject AND o.y = s.year AND dearest > 200000
LEFT JOIN season_team t ON t.player = subject AND t.year = s.year LEFT JOIN supply_year u ON u.team = t.team AND u.y = s.year""")
def attach_filter_is_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a source drops the cells without a partner; other sources' joins stay as they are."""
    attached = (Attached("placed", "order_year", "placed", where=(Filter("dearest", ">", 200000),)), Attached("sent", "supply_year", "sent"))
    return plan_view(sourced_catalog(spark, sf_dir), ViewRequest((), axes=("year",), years=(1995, 1996), attached=attached, limit=None))


@query(f"""WITH {_SOURCES}, s AS (SELECT n.*, 1996 AS year, week FROM nations n, (SELECT DISTINCT week FROM lines WHERE year = 1996)) SELECT subject, CAST(s.year AS INTEGER) AS year, s.week, n_name, r_name, v.many AS faced, w.many AS faces_next, u.sent AS opponent_sent, x.served
FROM s LEFT JOIN opponent o ON o.home = subject AND o.year = s.year AND o.week = s.week LEFT JOIN suppliers v ON v.team = o.other LEFT JOIN supply_year u ON u.team = o.other AND u.y = s.year
LEFT JOIN opponent p ON p.home = subject AND p.year = s.year AND p.week = s.week + 1 LEFT JOIN suppliers w ON w.team = p.other LEFT JOIN supply_year x ON x.team = subject AND x.y = s.year""")
def attach_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team's opponent of the week and of the next one, beside its own year."""
    attached = (
        Attached("faced", "suppliers", "many", "opponent"), Attached("faces_next", "suppliers", "many", "next_opponent"),
        Attached("opponent_sent", "supply_year", "sent", "opponent"), Attached("served", "supply_year", "served"),
    )
    return plan_view(sourced_catalog(spark, sf_dir), ViewRequest((), grain="team", axes=("year", "week"), years=(1996,), attached=attached, limit=None))


@query(f"""WITH {_SOURCES}, s AS ({_PLAYER_YEARS}) SELECT s.*, dearest FROM s JOIN order_year ON o_custkey = subject AND y = s.year ORDER BY dearest DESC NULLS LAST, subject, s.year LIMIT 300""")
def sort_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by a column of a leading source first: subjects that it lacks are left out."""
    return plan_view(sourced_catalog(spark, sf_dir), ViewRequest((), axes=("year",), years=(1995, 1996), attached=(Attached("dearest", "order_year", "dearest"),), sort=(("dearest", True),), limit=300))


@query(f"""WITH {_SOURCES}, m AS (SELECT c_nationkey AS subject, CAST(sum(price) AS DOUBLE) AS a, CAST(sum(price) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS b FROM lines GROUP BY ALL), t AS (SELECT * FROM nations LEFT JOIN m USING (subject) LEFT JOIN suppliers ON team = subject)
SELECT subject, n_name, r_name, a AS revenue_0, CASE WHEN b >= 2000000 THEN b END AS revenue_1, richest, round(a - CASE WHEN b >= 2000000 THEN b END, 2) AS difference, round((a - CASE WHEN b >= 2000000 THEN b END) / nullif(richest, 0), 4) AS scaled FROM t""")
def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell with a bound of its own, and differences over finished and attached columns."""
    columns = (ViewColumn("revenue"), ViewColumn("revenue", filters=(Filter("l_returnflag", "=", "R"),), cell_having=((">=", 2000000),)))
    computed = (("difference", "round(revenue_0 - revenue_1, 2)"), ("scaled", "round(try_divide(difference, nullif(richest, 0)), 4)"))
    return plan_view(sourced_catalog(spark, sf_dir), ViewRequest(columns, grain="team", attached=(Attached("richest", "suppliers", "richest"),), computed=computed, limit=None))

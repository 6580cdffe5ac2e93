"""Registered queries on columns of the player and of its contract, and on facts that do not count."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scalar
from tidemark.plans.model import Output, ViewColumn, ViewRequest
from tidemark.plans.view import plan_view
from tidemark.registry import query
from tidemark.sources.star import star_catalog, table


@query("""WITH p AS (SELECT p_partkey, p_size + 180 AS weight, CASE WHEN p_partkey % 9 <> 0 THEN 4.0 + p_partkey % 7 / 8 END AS seconds, 64 + p_partkey % 16 AS height, ['WR', 'TE', 'RB'][1 + p_partkey % 3] AS position FROM part)
SELECT p_partkey, CASE WHEN position <> 'RB' AND seconds > 0 THEN round(weight * 200.0::DOUBLE / pow(seconds, 4) * (height / CASE position WHEN 'TE' THEN 76.4::DOUBLE ELSE 73.0::DOUBLE END), 2) END AS score FROM p""")
def speed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    seconds = F.when(key % 9 != 0, 4.0 + key % 7 / 8)
    position = F.get(F.array(*map(F.lit, ("WR", "TE", "RB"))), (key % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.speed_score(F.col("p_size") + 180, seconds, 64 + key % 16, position).alias("score"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS owner, c_custkey % 10 AS k, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 40 END AS salary, ['QB', 'RB', 'WR', 'TE', 'K'][1 + c_custkey % 5] AS position, CASE c_custkey % 6 WHEN 0 THEN 'franchise' WHEN 1 THEN 'rookie' END AS tag, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END AS extensions FROM customer)
SELECT c_custkey, CAST(CASE WHEN k = 0 THEN coalesce(salary, 0) WHEN tag = 'franchise' THEN CASE position WHEN 'QB' THEN 50 WHEN 'RB' THEN 40 WHEN 'WR' THEN 45 WHEN 'TE' THEN 20 ELSE 0 END WHEN tag = 'rookie' THEN coalesce(salary, 0) ELSE coalesce(salary, 0) + (coalesce(extensions, 0) + 1) * 5 END AS BIGINT) AS extended,
CASE WHEN tag IS NULL OR k >= 7 OR owner = 3 THEN tag ELSE 'regular' END AS tag_seen FROM c""")
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salaries after extension, and tags as the owner of team 3 sees them."""
    key = F.col("c_custkey")
    position = F.get(F.array(*map(F.lit, ("QB", "RB", "WR", "TE", "K"))), (key % 5).cast("int"))
    tag = F.when(key % 6 == 0, "franchise").when(key % 6 == 1, "rookie")
    prices = {p: F.lit(v) for p, v in {"QB": 50, "RB": 40, "WR": 45, "TE": 20}.items()}
    extended = scalar.extended_salary(F.when(key % 13 != 0, key % 40), F.when(key % 10 == 0, "PS").otherwise("BENCH"), tag, position, F.when(key % 4 != 0, key % 4), prices)
    seen = scalar.masked(tag, F.col("c_nationkey"), 3, key % 10 >= 7, "regular")
    return table(spark, sf_dir, "customer").select("c_custkey", extended.cast("long").alias("extended"), seen.alias("tag_seen"))


@query("""WITH $LINES, f AS (SELECT * FROM lines WHERE l_returnflag <> 'N') SELECT s_suppkey AS subject, s_name, CAST(sum(price) AS DOUBLE) AS revenue_0, CAST(count(l_linenumber) AS DOUBLE) AS lines_0,
CAST(round(CAST(CAST(CAST(sum(price) AS DOUBLE) / nullif(count(DISTINCT o_orderkey), 0) AS VARCHAR) AS DECIMAL(36,14)), 4) AS DOUBLE) AS revenue_1 FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey GROUP BY ALL""")
def view_live_plays_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that do not count are in no total and no denominator."""
    catalog = replace(star_catalog(spark, sf_dir), live="l_returnflag <> 'N'")
    return plan_view(catalog, ViewRequest((ViewColumn("revenue"), ViewColumn("lines"), ViewColumn("revenue", Output("rate", "game"))), grain="receiver", limit=None))

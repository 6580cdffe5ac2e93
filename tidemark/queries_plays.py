"""Registered queries on the plays view, rate denominators of roles, and pairs of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import joins, ordered
from tidemark.plans.model import Filter
from tidemark.plans.plays import PlaysRequest, plan_plays
from tidemark.registry import query
from tidemark.sources.star import order_lines, table


@query("""WITH $LINES SELECT o_orderkey, l_linenumber, l_partkey, year, CAST(price AS DOUBLE) AS price FROM lines WHERE year IN (1995, 1996) AND l_returnflag = 'R' ORDER BY lines.price DESC, o_orderkey, l_linenumber, l_partkey LIMIT 2000""")
def plays_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = PlaysRequest(("o_orderkey", "l_linenumber", "l_partkey", "year", "l_extendedprice"), (Filter("year", "IN", (1995, 1996)), Filter("l_returnflag", "=", "R")), sort=(("l_extendedprice", True),), limit=5000)
    rows = plan_plays(order_lines(spark, sf_dir), request, ("o_orderkey", "l_linenumber", "l_partkey"))
    return rows.withColumn("price", F.col("l_extendedprice").cast("double")).drop("l_extendedprice")


@query("""WITH $LINES SELECT l_suppkey, year, count(*) AS plays, CAST(max(price) AS DOUBLE) AS longest, round(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*), 4) AS rate FROM lines WHERE qty >= 10 GROUP BY ALL HAVING count(*) >= 5 ORDER BY plays DESC, l_suppkey, year LIMIT 300""")
def plays_by_supplier_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = PlaysRequest(filters=(Filter("l_quantity", ">=", 10),), group_by=("l_suppkey", "year"), having=(Filter("plays", ">=", 5),), sort=(("plays", True),), limit=300)
    returned = F.count(F.when(F.col("l_returnflag") == "R", 1))
    aggregates = {"plays": F.count("*"), "longest": F.max("l_extendedprice").cast("double"), "rate": F.round(returned.cast("double") / F.count("*"), 4)}
    return plan_plays(order_lines(spark, sf_dir), request, (), aggregates)


@query("""WITH $LINES, u AS (SELECT o_custkey AS subject, 'customer' AS role, price FROM lines UNION ALL SELECT l_suppkey, 'supplier', price FROM lines)
SELECT subject, count(*) FILTER (WHERE role = 'customer') AS own, count(*) FILTER (WHERE role = 'supplier') AS served, count(*) AS touches, round(CAST(sum(price) FILTER (WHERE role = 'customer') AS DOUBLE) / count(*), 4) AS per_touch FROM u GROUP BY ALL""")
def role_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = joins.role_union(order_lines(spark, sf_dir), {"customer": "o_custkey", "supplier": "l_suppkey"}, ["l_extendedprice"])
    role = lambda r, c=F.lit(1): F.when(F.col("role") == r, c)
    return credits.groupBy("subject").agg(
        F.count(role("customer")).alias("own"), F.count(role("supplier")).alias("served"), F.count("*").alias("touches"),
        F.round(F.sum(role("customer", F.col("l_extendedprice"))).cast("double") / F.count("*"), 4).alias("per_touch"),
    )


@query("""WITH $LINES, s AS (SELECT o_custkey, year, s_nationkey, count(*) AS n FROM lines JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY n DESC, s_nationkey) AS r FROM s) WHERE r = 1),
t AS (SELECT s_nationkey, year, count(*) AS team_plays FROM lines JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), p AS (SELECT o_custkey, year, sum(price) AS v FROM lines GROUP BY ALL)
SELECT o_custkey, round(CAST(sum(v) AS DOUBLE) / sum(team_plays), 4) AS per_team_play, count(*) AS seasons FROM p JOIN m USING (o_custkey, year) JOIN t USING (s_nationkey, year) GROUP BY ALL""")
def rate_over_years_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's numerator meets the plays of that season's team; then both are summed."""
    lines = order_lines(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    team = joins.mode_per_key(lines, ["o_custkey", "year"], "s_nationkey").select("o_custkey", "year", "s_nationkey")
    plays = lines.groupBy("s_nationkey", "year").agg(F.count("*").alias("team_plays"))
    own = lines.groupBy("o_custkey", "year").agg(F.sum("l_extendedprice").alias("v"))
    whole = own.join(team, ["o_custkey", "year"]).join(plays, ["s_nationkey", "year"])
    return whole.groupBy("o_custkey").agg(F.round(F.sum("v").cast("double") / F.sum("team_plays"), 4).alias("per_team_play"), F.count("*").alias("seasons"))


@query("""WITH $LINES, h AS (SELECT DISTINCT year, week, c_nationkey AS team, l_returnflag || l_linestatus AS pick FROM lines WHERE qty >= 48), n AS (SELECT team, count(DISTINCT (year, week)) AS weeks FROM h GROUP BY ALL)
SELECT a.team, a.pick AS a, b.pick AS b, count(*) AS together, round(CAST(count(*) AS DOUBLE) / any_value(weeks), 6) AS joint_rate FROM h a JOIN h b ON a.team = b.team AND a.year = b.year AND a.week = b.week AND a.pick < b.pick JOIN n ON n.team = a.team GROUP BY ALL""")
def selection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two selections of a team hit in one week. A team's selections are a few kinds."""
    homes = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("team"))
    lines = order_lines(spark, sf_dir).filter("l_quantity >= 48").join(homes, F.col("o_custkey") == F.col("c_custkey"))
    weeks = lines.filter("team is not null").groupBy("team", "year", "week").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("picks"))
    totals = weeks.groupBy("team").agg(F.count("*").alias("weeks"))
    pairs = F.flatten(F.transform("picks", lambda a: F.transform(F.filter("picks", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = weeks.select("team", F.explode(pairs).alias("p")).groupBy("team", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("together"))
    return met.join(totals, "team").select("team", "a", "b", "together", F.round(F.col("together").cast("double") / F.col("weeks"), 6).alias("joint_rate"))


@query("""WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS class, min((o_orderdate, o_orderkey)) AS first FROM orders GROUP BY ALL) SELECT o_custkey, class, row_number() OVER (PARTITION BY class ORDER BY first, o_custkey) AS class_rank FROM f""")
def class_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    placed = firsts.withColumn("class", F.year("first.o_orderdate").cast("long"))
    return ordered.row_numbers(placed, ["class"], ["first", "o_custkey"], "class_rank").select("o_custkey", "class", "class_rank")


#: The points of a percentile vector, as parts of all rows; least and greatest are the ends.
POINTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99": 0.99, "min": 0.0, "max": 1.0}


@query("""WITH v AS (SELECT p_brand, p_retailprice AS v FROM part WHERE p_size >= 5), q AS (SELECT p_brand, unnest([25, 50, 75, 90, 95, 98, 99, 0, 100]) AS p,
unnest([quantile_disc(v, 0.25), quantile_disc(v, 0.5), quantile_disc(v, 0.75), quantile_disc(v, 0.9), quantile_disc(v, 0.95), quantile_disc(v, 0.98), quantile_disc(v, 0.99), min(v), max(v)]) AS value,
unnest([quantile_disc(v, 0.75), quantile_disc(v, 0.5), quantile_disc(v, 0.25), quantile_disc(v, 0.1), quantile_disc(v, 0.05), quantile_disc(v, 0.02), quantile_disc(v, 0.01), max(v), min(v)]) AS reversed FROM v GROUP BY p_brand)
SELECT p_brand, CASE p WHEN 0 THEN 'min' WHEN 100 THEN 'max' ELSE 'p' || p END AS name, value FROM q UNION ALL SELECT p_brand, CASE p WHEN 0 THEN 'min' WHEN 100 THEN 'max' ELSE 'p' || p END || '_reversed', reversed FROM q""")
def percentile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that qualify, the nine points of a statistic, and those of one where less is better."""
    qualified = table(spark, sf_dir, "part").filter("p_size >= 5")
    points = {n: (q, "disc") for n, q in POINTS.items()} | {f"{n}_reversed": (round(1 - q, 2), "disc") for n, q in POINTS.items()}
    return ordered.quantiles(qualified, ["p_brand"], "p_retailprice", points).unpivot("p_brand", list(points), "name", "value")

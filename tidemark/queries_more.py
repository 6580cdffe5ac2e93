"""Queries on resolution, signals, scoped rates and as-of means, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import joins
from tidemark.registry import query
from tidemark.sources.star import order_lines, table


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
w AS (SELECT c_custkey AS o_custkey, k AS months, TIMESTAMP '1997-01-01' - to_months(CAST(k AS INTEGER)) AS moment FROM customer, (VALUES (0), (6), (12)) AS k(k)),
m AS (SELECT w.o_custkey, months, v, row_number() OVER (PARTITION BY w.o_custkey, months ORDER BY o_orderdate DESC, v DESC) AS r FROM w JOIN o ON o.o_custkey = w.o_custkey AND o_orderdate <= moment)
SELECT o_custkey, count(*) AS observed, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS mean_value FROM m WHERE r = 1 GROUP BY o_custkey""")
def asof_offsets_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the values last seen at each of three offsets from a date; unseen ones do not count."""
    observed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    offsets = F.explode(F.array(*map(F.lit, (0, 6, 12)))).alias("months")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), offsets)
    asked = asked.withColumn("at", F.expr("timestamp_ntz'1997-01-01 00:00:00' - make_ym_interval(0, months)"))
    found = joins.asof_join(asked, observed, ["o_custkey"], "at", "o_orderdate", ["v"]).filter("asof_v is not null")
    return found.groupBy("o_custkey").agg(F.count("*").alias("observed"), F.round(F.sum("asof_v").cast("double") / F.count("*"), 4).alias("mean_value"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p.p_partkey IS NOT NULL THEN 'part' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' ELSE 'line' END AS resolved_by,
coalesce(p.p_partkey, s.s_suppkey, l_suppkey) AS resolved
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) p ON l_partkey = p.p_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s.s_suppkey""")
def two_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first id where it is known, else a second one, else the role column itself."""
    first = table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey")
    second = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    met = lines.join(first, F.col("l_partkey") == F.col("p_partkey"), "left").join(second, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    by = F.when(F.col("p_partkey").isNotNull(), "part").when(F.col("s_suppkey").isNotNull(), "supplier").otherwise("line")
    return met.select("l_orderkey", "l_linenumber", by.alias("resolved_by"), F.coalesce("p_partkey", "s_suppkey", "l_suppkey").alias("resolved"))


@query("""WITH o AS (SELECT o_custkey, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS closed, max(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS urgent FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1),
r AS (SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND year(o_orderdate) = 1996)
SELECT c_custkey, CAST(coalesce(closed, 0) + coalesce(urgent, 0) + (CASE WHEN r.o_custkey IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c_acctbal < (CASE WHEN c_nationkey < 10 THEN 0 ELSE 1000 END) THEN 1 ELSE 0 END) AS INTEGER) AS signals
FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN r ON c_custkey = r.o_custkey""")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of four independent signals hold for each row of the spine, one with a threshold by group."""
    orders = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1996)
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    own = orders.groupBy("o_custkey").agg(flag(F.col("o_orderstatus") == "F").alias("closed"), flag(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    returned = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_custkey").distinct().withColumn("returned", F.lit(1))
    spine = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    low = (F.col("c_acctbal") < F.when(F.col("c_nationkey") < 10, 0).otherwise(1000)).cast("int")
    met = spine.join(own, "o_custkey", "left").join(returned, "o_custkey", "left")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("closed", "urgent", "returned")), low)
    return met.select(F.col("o_custkey").alias("c_custkey"), total.cast("int").alias("signals"))


@query("""WITH $LINES, t AS (SELECT DISTINCT o_custkey, year, s_nationkey FROM lines JOIN supplier ON l_suppkey = s_suppkey)
SELECT o_custkey, string_agg(CAST(s_nationkey AS VARCHAR), ',' ORDER BY s_nationkey) AS teams FROM (SELECT DISTINCT o_custkey, s_nationkey FROM t) GROUP BY 1""")
def team_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the teams that a subject has in each year; at most as many as there are nations."""
    lines = order_lines(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    yearly = lines.groupBy("o_custkey", "year").agg(F.collect_set("s_nationkey").alias("teams"))
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("teams"))))
    return yearly.groupBy("o_custkey").agg(F.concat_ws(",", F.transform(union, lambda t: t.cast("string"))).alias("teams"))


@query("""WITH $LINES SELECT o_custkey, year, count(*) AS plays, round(CAST(sum(price) AS DOUBLE) / nullif(count(week), 0), 6) AS per_row, round(CAST(sum(price) AS DOUBLE) / nullif(count(DISTINCT week), 0), 6) AS per_week
FROM lines GROUP BY ALL HAVING count(*) >= 8 AND CAST(sum(price) AS DOUBLE) BETWEEN 100000 AND 2000000""")
def period_rate_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a measure over its own periods, for the groups that pass filters on their aggregates."""
    weekly = order_lines(spark, sf_dir).groupBy("o_custkey", "year", "week").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    seasons = weekly.groupBy("o_custkey", "year").agg(F.sum("n").alias("plays"), F.count("*").alias("weeks"), F.sum("v").cast("double").alias("v"))
    kept = seasons.filter("plays >= 8 and v between 100000 and 2000000")
    return kept.select("o_custkey", "year", "plays", F.round(F.col("v") / F.col("plays"), 6).alias("per_row"), F.round(F.col("v") / F.col("weeks"), 6).alias("per_week"))


@query("""WITH $LINES, r AS (SELECT CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS first_role, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS second_role, o_custkey AS third_role, price, year FROM lines)
SELECT coalesce(first_role, second_role, third_role) AS subject, year, count(*) AS plays, CAST(sum(price) AS DOUBLE) AS total FROM r GROUP BY ALL""")
def declared_role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row goes to its first role in declared order; one pass for all roles."""
    roles = [F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")), F.when(F.col("l_linestatus") == "F", F.col("l_partkey")), F.col("o_custkey")]
    lines = order_lines(spark, sf_dir).withColumn("subject", F.coalesce(*roles))
    return lines.groupBy("subject", "year").agg(F.count("*").alias("plays"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""WITH t AS (SELECT o_orderpriority, c_mktsegment, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, c_mktsegment ORDER BY v DESC, o_custkey) AS r FROM t),
s AS (SELECT o_orderpriority, c_mktsegment, CAST(sum(v) AS DOUBLE) / count(*) AS top_mean, count(*) AS n FROM r WHERE r <= 12 GROUP BY ALL)
SELECT o_orderpriority, c_mktsegment, n, round(top_mean, 4) AS top_mean, round(top_mean / sum(top_mean) OVER (PARTITION BY o_orderpriority), 6) AS share FROM s""")
def top_mean_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the twelve best of each group and its share among the groups of a class."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    groups = ["o_orderpriority", "c_mktsegment"]
    totals = orders.join(customers, "o_custkey").groupBy(*groups, "o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    best = joins.top_per_key(totals, groups, 12, F.desc("v"), F.col("o_custkey"))
    means = best.groupBy(*groups).agg((F.sum("v").cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    whole = means.groupBy("o_orderpriority").agg(F.sum("mean").alias("whole"))
    return means.join(whole, "o_orderpriority").select(*groups, "n", F.round("mean", 4).alias("top_mean"), F.round(F.col("mean") / F.col("whole"), 6).alias("share"))

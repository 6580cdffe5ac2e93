"""Registered queries on values as of moments of a season, and of analog years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import boundaries, joins
from tidemark.registry import query
from tidemark.sources.star import by_order, table


@query("""WITH a AS (SELECT o_orderkey, year(o_orderdate) + o_orderkey % 4 AS pick_year, o_orderkey % 3 AS round, o_custkey % 2 AS slot, CAST(o_orderdate AS DATE) AS moment FROM orders),
s AS (SELECT year(o_orderdate) + l_partkey % 3 AS pick_year, l_suppkey % 3 AS round, l_linenumber % 2 AS slot, CAST(o_orderdate AS DATE) AS day, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (year(o_orderdate) + l_partkey % 3) % 4 <> 1 GROUP BY ALL),
e AS (SELECT o_orderkey, arg_max(s.value, s.day) AS exact FROM a JOIN s ON s.pick_year = a.pick_year AND s.round = a.round AND s.slot = a.slot AND s.day <= a.moment GROUP BY ALL),
w AS (SELECT pick_year AS y, round, slot, min(day) AS first, max(day) AS last FROM s GROUP BY ALL),
c AS (SELECT a.o_orderkey, w.y, w.round, w.slot, first, last, CAST(make_date(w.y - (a.pick_year - year(a.moment)), month(a.moment), 1) + INTERVAL (day(a.moment) - 1) DAY AS DATE) AS target FROM a JOIN w USING (round, slot) WHERE a.o_orderkey NOT IN (SELECT o_orderkey FROM e)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY least(target - first, last - target) DESC, y) AS r FROM c WHERE target BETWEEN first AND last) WHERE r = 1),
g AS (SELECT o_orderkey, arg_max(s.value, s.day) AS analog FROM b JOIN s ON s.pick_year = b.y AND s.round = b.round AND s.slot = b.slot AND s.day <= b.target GROUP BY ALL)
SELECT o_orderkey, CAST(coalesce(exact, analog) AS DOUBLE) AS value, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN analog IS NOT NULL THEN 'analog' END AS known FROM a LEFT JOIN e USING (o_orderkey) LEFT JOIN g USING (o_orderkey)""")
def pick_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pick of a year, round and slot was worth on a day; years without a series use another one's."""
    orders = table(spark, sf_dir, "orders")
    asked = orders.select("o_orderkey", (F.year("o_orderdate") + F.col("o_orderkey") % 4).cast("int").alias("pick_year"), (F.col("o_orderkey") % 3).alias("round"), (F.col("o_custkey") % 2).alias("slot"), F.to_date("o_orderdate").alias("at"))
    calendar = orders.select("o_orderkey", F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).cast("int").alias("later"), (F.col("l_suppkey") % 3).alias("round"), (F.col("l_linenumber") % 2).cast("long").alias("slot"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    series = by_order(spark, sf_dir, lines, calendar).select((F.col("season") + F.col("later")).alias("pick_year"), "round", "slot", "day", "value")
    series = series.filter("pick_year % 4 <> 1").groupBy("pick_year", "round", "slot", "day").agg(F.max("value").alias("value"))
    found = boundaries.asof_or_analog(asked, series, "o_orderkey", "pick_year", ["round", "slot"], "at", "day", "value")
    return found.select("o_orderkey", F.col("value").cast("double").alias("value"), "known")


@query("""WITH y AS (SELECT unnest([1995, 1996, 1997]) AS year), o AS (SELECT year(o_orderdate) AS year, CAST(min(o_orderdate) + INTERVAL 20 DAY AS DATE) AS opening FROM orders GROUP BY ALL),
b AS (SELECT y.year, least(make_date(y.year + 1, 2, 1) + 29, DATE '1997-06-30') AS by_date, least(CAST(o.opening + INTERVAL 12 MONTH AS DATE), DATE '1997-06-30') AS by_opening FROM y JOIN o USING (year)),
s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(year AS INTEGER) AS year, CAST((SELECT arg_max(v, day) FROM s WHERE s.o_custkey = c_custkey AND day <= by_date AND day > by_date - 30) AS DOUBLE) AS by_date, CAST((SELECT arg_max(v, day) FROM s WHERE s.o_custkey = c_custkey AND day <= by_opening AND day > by_opening - 30) AS DOUBLE) AS by_opening FROM customer, b""")
def season_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values last seen within 30 days before a day of the next year, and before its opening day, but not after a fixed now."""
    orders, now = table(spark, sf_dir, "orders"), F.lit("1997-06-30").cast("date")
    openings = orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.to_date(F.date_add(F.min("o_orderdate"), 20)).alias("opening")).filter("year in (1995, 1996, 1997)")
    moments = openings.select("year", boundaries.moment_of_year(F.col("year"), 2, 30, 1, now).alias("by_date"), boundaries.moment_of_opening(F.col("opening"), 1, now).alias("by_opening"))
    asked = table(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(moments))  # three years
    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")).agg(F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    for moment in ("by_date", "by_opening"):
        asked = joins.asof_join(asked, seen, ["c_custkey"], moment, "day", ["v"], within="30 days").withColumn(f"{moment}_v", F.col("asof_v").cast("double")).drop("asof_day", "asof_v")
    return asked.select("c_custkey", "year", F.col("by_date_v").alias("by_date"), F.col("by_opening_v").alias("by_opening"))

"""Registered queries on histories: hit rates, wagers, changes, carry-forward, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scalar
from tidemark.operators import history
from tidemark.registry import query
from tidemark.sources.star import order_lines, table, tasks
from tidemark.streaming import windows


@query("""WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS year, o_orderdate, CASE WHEN o_totalprice >= 150000 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM orders),
l AS (SELECT o_custkey, year + 1 AS year, avg(hit) AS last_season FROM o GROUP BY o_custkey, o.year)
SELECT o.o_custkey, o.o_orderkey, round(avg(hit) OVER (c ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS last_5, round(avg(hit) OVER (c ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS last_10,
round(avg(hit) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS all_before, round(avg(hit) OVER (PARTITION BY o.o_custkey, o.year ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS this_season,
round(last_season, 6) AS last_season, round(avg(hit) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 / 1.909091, 4) AS edge
FROM o LEFT JOIN l ON l.o_custkey = o.o_custkey AND l.year = o.year WINDOW c AS (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey)""")
def hit_rates_and_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), "o_orderdate", "o_totalprice")
    rated = history.hit_rates(orders, "o_custkey", "year", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") >= 150000)
    edge = F.round(F.col("all_before") - scalar.implied_probability(F.lit(1.909091)), 4).alias("edge")
    return rated.select("o_custkey", "o_orderkey", *[F.round(c, 6).alias(c) for c in ("last_5", "last_10", "all_before", "this_season", "last_season")], edge)


@query("""WITH $LINES, g AS (SELECT o_orderkey, CASE l_returnflag WHEN 'R' THEN 'WON' WHEN 'A' THEN 'LOST' ELSE CASE WHEN l_linestatus = 'O' THEN 'PUSH' END END AS state, 1 + disc AS odds FROM lines),
w AS (SELECT o_orderkey, count(*) AS legs, count(*) FILTER (WHERE state = 'LOST') AS lost, count(*) FILTER (WHERE state IS NULL) AS open, round(exp(sum(ln(CASE WHEN state = 'PUSH' THEN 1.0 ELSE CAST(odds AS DOUBLE) END))), 6) AS odds FROM g GROUP BY ALL)
SELECT *, CASE WHEN lost > 0 THEN 'LOST' WHEN open > 0 THEN 'OPEN' ELSE 'WON' END AS result, lost = 1 AND open = 0 AS near_miss FROM w""")
def parlay_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "WON").when(F.col("l_returnflag") == "A", "LOST").when(F.col("l_linestatus") == "O", "PUSH")
    legs = order_lines(spark, sf_dir).select("o_orderkey", state.alias("state"), (1 + F.col("l_discount")).alias("odds"))
    return history.parlays(legs, "o_orderkey", "state", "odds")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id)
SELECT s.user_id, CAST(s.day AS VARCHAR) AS day, d.value FROM s ASOF JOIN d ON s.user_id = d.user_id AND s.day >= d.day""")
def daily_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.daily_carry(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id").withColumn("day", F.col("day").cast("string"))


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT c_custkey, 'c_mktsegment' AS "column", c.c_mktsegment AS old, n.c_mktsegment AS new FROM n JOIN customer c USING (c_custkey) WHERE n.c_mktsegment IS DISTINCT FROM c.c_mktsegment
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey + 1 AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0""")
def changed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer")
    new = old.withColumns({"c_nationkey": F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), "c_mktsegment": F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))})
    return history.changes(old, new, ["c_custkey"], ["c_nationkey", "c_mktsegment"])


@query("""WITH $LINES, v AS (SELECT DISTINCT o_orderkey, l_suppkey, sum(price) OVER (PARTITION BY o_orderkey, l_suppkey) AS p FROM lines)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n, round(corr(CAST(a.p AS DOUBLE), CAST(b.p AS DOUBLE)), 6) AS r, round(corr(CAST(a.p AS DOUBLE), CAST(b.p AS DOUBLE)) * count(*) / (count(*) + 10.0), 6) AS shrunk
FROM v a JOIN v b ON a.o_orderkey = b.o_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 5""")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = order_lines(spark, sf_dir).groupBy("o_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").cast("double").alias("p"))
    made = history.pair_correlations(values, "o_orderkey", "l_suppkey", "p", 5, 10.0, tasks(table(spark, sf_dir, "lineitem")))
    return made.withColumns({"r": F.round("r", 6), "shrunk": F.round("shrunk", 6)})


@query("""SELECT user_id, arg_min(value, (ts, event_id)) AS open_value, arg_max(value, (ts, event_id)) AS close_value, min(ts) AS opened, max(ts) AS closed, count(*) AS n FROM events GROUP BY ALL""")
def stream_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drain(windows.open_close(windows.table_stream(spark, sf_dir), "user_id"))


@query("""SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drain(windows.sliding_counts(windows.table_stream(spark, sf_dir)))


@query("""SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL""")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = windows.table_stream(spark, sf_dir).join(customers, "user_id")
    return windows.drain(joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")))


@query("""SELECT event_id, min(ts) AS ts, any_value(user_id) AS user_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_id""")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = windows.table_stream(spark, sf_dir)
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return windows.drain(windows.deduplicated(doubled, ["event_id"]).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id"), "append")

"""Registered queries on holdings, their transformations and closure, trades and daily values.

Parts are the assets and regions the teams. Lines are the events: R a release by the supplier's
region, A an acquisition by the customer's, N a leg of the order's trade where the order is urgent
or high (between the customer's region and another one, there and back by line), else an endowment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import lineage
from tidemark.registry import query
from tidemark.sources.star import by_order, table

ORDER = ["day", "l_orderkey", "l_linenumber", "l_suppkey"]

EVENTS = """ev AS (
  SELECT l_partkey AS asset, CAST(o_orderdate AS DATE) AS day, l_orderkey, l_linenumber, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(l_quantity AS DECIMAL(18,2)) AS salary,
         CASE WHEN l_returnflag = 'R' THEN 'release' WHEN l_returnflag = 'A' THEN 'acquire' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'move' ELSE 'endow' END AS kind,
         h.n_regionkey AS home, s.n_regionkey AS away, (h.n_regionkey + 1 + o_orderkey % 4) % 5 AS other,
         row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(o_orderdate AS DATE), l_orderkey, l_linenumber, l_suppkey) AS i
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey),
evs AS (SELECT *, CASE WHEN kind = 'release' THEN away WHEN kind = 'move' AND l_linenumber % 2 = 0 THEN other ELSE home END AS team, CASE WHEN kind = 'move' THEN CASE WHEN l_linenumber % 2 = 0 THEN home ELSE other END END AS giver FROM ev)"""

#: An asset's state after each of its events, one event at a time.
FOLD = EVENTS + """, fold AS (
  SELECT asset, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS number, CAST(NULL AS INTEGER) AS team, CAST(NULL AS DECIMAL(18,2)) AS paid, false AS held, '' AS kind, CAST(NULL AS DATE) AS day, false AS ended, CAST(NULL AS BIGINT) AS trade, CAST(NULL AS INTEGER) AS giver, CAST(NULL AS DECIMAL(18,2)) AS value, CAST(NULL AS INTEGER) AS was
  FROM (SELECT DISTINCT asset FROM evs)
  UNION ALL
  SELECT e.asset, e.i, number + CASE WHEN e.kind = 'release' THEN 0 ELSE 1 END, CASE WHEN e.kind = 'release' THEN f.team ELSE CAST(e.team AS INTEGER) END,
         CASE e.kind WHEN 'release' THEN paid WHEN 'acquire' THEN e.salary WHEN 'endow' THEN NULL ELSE CASE WHEN held THEN paid END END,
         CASE WHEN e.kind = 'release' THEN held AND f.team <> e.team ELSE true END, e.kind, e.day, held AND (e.kind <> 'release' OR f.team = e.team),
         CASE WHEN e.kind = 'move' THEN e.l_orderkey END, CAST(e.giver AS INTEGER), e.value, CASE WHEN held THEN f.team END
  FROM fold f JOIN evs e ON e.asset = f.asset AND e.i = f.i + 1),
opened AS (SELECT * FROM fold WHERE i > 0 AND kind <> 'release'),
ends AS (SELECT asset, CASE WHEN kind = 'release' THEN number ELSE number - 1 END AS number, day AS period_end, CASE WHEN kind = 'release' THEN 'release' WHEN kind = 'move' OR team <> was THEN 'trade' ELSE 'extension' END AS terminated_by FROM fold WHERE i > 0 AND ended),
held AS (SELECT o.asset, o.number, o.team, o.kind, o.giver, o.trade, o.value, o.day AS period_start, e.period_end, coalesce(terminated_by, 'still_held') AS terminated_by,
         CASE WHEN o.ended THEN o.number - 1 END AS previous, o.was AS previous_team, o.paid AS salary_paid, o.asset || ':' || o.number AS name, CASE WHEN o.ended THEN o.asset || ':' || (o.number - 1) END AS source
         FROM opened o LEFT JOIN ends e USING (asset, number)),
given AS (SELECT trade, giver AS team, source, value AS gave FROM held WHERE kind = 'move' AND previous_team = giver),
received AS (SELECT trade, team, name AS target, value AS got FROM held WHERE kind = 'move'),
became AS (SELECT source, target, trade, team, CAST(gave AS DOUBLE) / CAST((SELECT sum(gave) FROM given x WHERE x.trade = g.trade AND x.team = g.team) AS DOUBLE) AS source_share,
           CAST(got AS DOUBLE) / CAST((SELECT sum(got) FROM received y WHERE y.trade = g.trade AND y.team = g.team) AS DOUBLE) AS target_share FROM given g JOIN received r USING (trade, team)),
edges AS (SELECT source, target, target_share AS share FROM became UNION ALL SELECT source, name, 1 FROM held WHERE kind <> 'move' AND previous_team = team),
"""


def asset_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = lambda side: table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(f"{side}_nation"), F.col("n_regionkey").alias(side))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(regions("home")), F.col("c_nationkey") == F.col("home_nation")).select("c_custkey", "home")  # a row a nation
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(regions("away")), F.col("s_nationkey") == F.col("away_nation")).select("s_suppkey", "away")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    met = by_order(spark, sf_dir, table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), orders)
    traded = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    kind = F.when(F.col("l_returnflag") == "R", "release").when(F.col("l_returnflag") == "A", "acquire").when(traded, "move").otherwise("endow")
    back, other = F.col("l_linenumber") % 2 == 0, ((F.col("home") + 1 + F.col("o_orderkey") % 4) % 5).cast("int")
    move = F.col("kind") == "move"
    rows = met.withColumns({"kind": kind, "other": other, "home": F.col("home").cast("int"), "away": F.col("away").cast("int"), "day": F.to_date("o_orderdate")})
    return rows.select(
        F.col("l_partkey").alias("asset"), *ORDER, F.col("day").alias("at"), "kind", F.when(F.col("kind") == "release", F.col("away")).when(move & back, F.col("other")).otherwise(F.col("home")).alias("team"),
        F.when(move, F.when(back, F.col("home")).otherwise(F.col("other"))).alias("giver"), F.when(move, F.col("o_orderkey")).alias("trade"),
        F.col("l_quantity").cast("decimal(18,2)").alias("salary"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
    )


def held_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset"))  # each is an event at most
    return lineage.holdings(asset_events(spark, sf_dir), ORDER, counted=lines)


@query("WITH RECURSIVE " + FOLD + """done AS (SELECT 1)
SELECT asset, number, team, kind, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, terminated_by, previous, CAST(salary_paid AS DOUBLE) AS salary_paid FROM held""")
def asset_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_assets(spark, sf_dir).select("asset", "number", "team", "kind", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "terminated_by", "previous", F.col("salary_paid").cast("double").alias("salary_paid"))


@query("WITH RECURSIVE " + FOLD + """done AS (SELECT 1)
SELECT source, name AS target, CASE WHEN kind = 'move' THEN 'trade' WHEN kind = 'acquire' AND previous_team = team THEN 'extension' WHEN kind = 'acquire' AND previous IS NOT NULL THEN 'poach' ELSE kind END AS type, CAST(period_start AS VARCHAR) AS at, trade,
       CASE WHEN source IS NOT NULL THEN 1.0::DOUBLE END AS source_share, 1.0::DOUBLE AS target_share FROM held WHERE kind <> 'move' OR source IS NOT NULL
UNION ALL SELECT name, NULL, 'release', CAST(period_end AS VARCHAR), NULL, 1.0, NULL FROM held WHERE terminated_by = 'release'""")
def asset_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.transformations(held_assets(spark, sf_dir)).withColumn("at", F.col("at").cast("string"))


@query("WITH RECURSIVE " + FOLD + "done AS (SELECT 1) SELECT source, target, trade, team, round(source_share, 9) AS source_share, round(target_share, 9) AS target_share FROM became")
def trade_considerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {c: F.round(c, 9) for c in ("source_share", "target_share")}
    return lineage.considerations(held_assets(spark, sf_dir)).withColumns(shares)


@query("WITH RECURSIVE " + FOLD + """walk AS (
  SELECT name AS root, name AS node, 0 AS depth, CAST(1 AS DOUBLE) AS weight, CASE WHEN salary_paid > 0 THEN 'salary' WHEN kind = 'endow' THEN 'endowment' ELSE 'derived' END AS root_kind FROM held
  UNION ALL SELECT root, e.target, depth + 1, weight * share, root_kind FROM walk JOIN edges e ON e.source = node WHERE depth < 20)
SELECT root, node, CAST(depth AS INTEGER) AS depth, round(sum(weight), 9) AS weight, root_kind FROM walk GROUP BY root, node, depth, root_kind""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_assets(spark, sf_dir)
    return lineage.closure(lineage.rooted(held), lineage.proceeds_edges(held), 20).withColumn("weight", F.round("weight", 9))


@query("WITH RECURSIVE " + FOLD + """walk AS (
  SELECT trade, team, name AS root, name AS node, 0 AS depth, CAST(1 AS DOUBLE) AS weight FROM held WHERE kind = 'move'
  UNION ALL SELECT trade, w.team, root, e.target, depth + 1, weight * share FROM walk w JOIN edges e ON e.source = node WHERE depth < 40),
paths AS (SELECT trade, team, root, node, depth, sum(weight) AS weight FROM walk GROUP BY ALL)
SELECT p.trade, p.team, count(DISTINCT root) AS received, count(*) AS reached, round(sum(weight * coalesce(date_diff('day', period_start, period_end), 0)), 6) AS days_held, round(sum(weight * coalesce(CAST(salary_paid AS DOUBLE), 0)), 6) AS salary,
       CASE WHEN bool_or(terminated_by = 'still_held') THEN 'still_held' WHEN bool_or(terminated_by = 'trade') THEN 'traded_onward' ELSE 'consumed' END AS outcome
FROM paths p JOIN held h ON h.name = p.node GROUP BY p.trade, p.team""")
def trade_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("days_held", "salary")}
    return lineage.trade_grades(held_assets(spark, sf_dir)).withColumns(rounded)


@query("WITH RECURSIVE " + FOLD + """prices AS (SELECT asset, day, max(value) AS value FROM evs GROUP BY ALL), bounds AS (SELECT team, min(day) AS low, max(day) AS high FROM (
    SELECT team, period_start AS day FROM held UNION ALL SELECT team, period_end FROM held UNION ALL SELECT h.team, p.day FROM held h JOIN prices p ON p.asset = h.asset AND p.day >= h.period_start AND (h.period_end IS NULL OR p.day < h.period_end)) GROUP BY team),
spans AS (SELECT asset, team, period_start AS low, coalesce(period_end, DATE '2100-01-01') AS high FROM held WHERE period_end IS NULL OR period_end > period_start),
worth AS (SELECT s.team, p.value, greatest(p.day, s.low) AS low, least(s.high, coalesce(p.until, DATE '2100-01-01')) AS high
          FROM spans s JOIN (SELECT *, lead(day) OVER (PARTITION BY asset ORDER BY day) AS until FROM prices) p ON p.asset = s.asset AND p.day < s.high AND coalesce(p.until, DATE '2100-01-01') > s.low),
days AS (SELECT team, CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
SELECT d.team, CAST(d.day AS VARCHAR) AS day, CAST(coalesce(sum(w.value), 0) AS DOUBLE) AS value FROM days d LEFT JOIN worth w ON w.team = d.team AND d.day >= w.low AND d.day < w.high GROUP BY d.team, d.day""")
def daily_team_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, events = held_assets(spark, sf_dir), asset_events(spark, sf_dir)
    # Of holdings that begin or end on one day the last one says who has the asset at its end.
    starts = held.select("asset", F.col("period_start").alias("day"), "number", F.lit(1).alias("opens"), "team")
    ends = held.filter("period_end is not null").select("asset", F.col("period_end").alias("day"), "number", F.lit(2).alias("opens"), F.lit(None).cast("int").alias("team"))
    states = starts.unionByName(ends).groupBy("asset", "day").agg(F.max(F.struct("number", "opens", "team"))["team"].alias("team"))
    values = events.groupBy("asset", F.col("at").alias("day")).agg(F.max("value").alias("value"))
    return lineage.daily_values(states, values).withColumns({"value": F.col("value").cast("double"), "day": F.col("day").cast("string")})

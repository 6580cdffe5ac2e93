"""Registered queries on lineups, combinations of selections, round robins and wagers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import selections, valuation
from tidemark.registry import query
from tidemark.sources.star import order_lines, table

#: Slots of a lineup: the positions that they take, and how many there are. None nests in another but the last.
LINEUP = [
    (("AUTOMOBILE",), 1), (("BUILDING",), 2), (("FURNITURE",), 1), (("AUTOMOBILE", "BUILDING"), 1), (("BUILDING", "FURNITURE", "MACHINERY"), 1),
    (("FURNITURE", "HOUSEHOLD"), 1), (("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), 1),
]


@query("""WITH $LINES, pts AS (SELECT year, c.c_nationkey AS team, o_custkey, c_mktsegment AS pos, sum(price) AS points FROM lines JOIN customer c ON o_custkey = c_custkey WHERE c.c_nationkey IS NOT NULL GROUP BY ALL),
tops AS (SELECT year, team, pos, row_number() OVER (PARTITION BY year, team, pos ORDER BY points DESC) AS k, sum(points) OVER (PARTITION BY year, team, pos ORDER BY points DESC ROWS UNBOUNDED PRECEDING) AS total FROM pts),
ways AS (SELECT row_number() OVER () AS way, a, b, c, d FROM (VALUES ('AUTOMOBILE'), ('BUILDING')) x(a), (VALUES ('BUILDING'), ('FURNITURE'), ('MACHINERY')) y(b), (VALUES ('FURNITURE'), ('HOUSEHOLD')) z(c), (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) w(d)),
counts AS (SELECT way, pos, count(*) AS n FROM (SELECT way, unnest(['AUTOMOBILE', 'BUILDING', 'BUILDING', 'FURNITURE', a, b, c, d]) AS pos FROM ways) GROUP BY ALL),
held AS (SELECT year, team, pos, max(k) AS have FROM tops GROUP BY ALL),
sums AS (SELECT t.year, t.team, way, sum(total) AS total, sum(k) AS starters FROM tops t JOIN held h USING (year, team, pos) JOIN counts c ON c.pos = t.pos AND t.k = least(c.n, h.have) GROUP BY ALL)
SELECT year, CAST(team AS INTEGER) AS team, CAST(max(total) AS DOUBLE) AS total, CAST(arg_max(starters, (total, starters)) AS BIGINT) AS starters FROM sums GROUP BY year, team""")
def optimal_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lineup of each team and year; the SQL tries every way to fill the flexible slots."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("team"), "c_mktsegment")
    points = order_lines(spark, sf_dir).join(customers, "o_custkey").filter("team is not null").groupBy("year", "team", "o_custkey", "c_mktsegment").agg(F.sum("l_extendedprice").alias("points"))
    chosen = valuation.lineups(points, ["year", "team"], "c_mktsegment", "points", "o_custkey", LINEUP)
    return chosen.groupBy("year", "team").agg(F.sum("points").cast("double").alias("total"), F.count("*").alias("starters"))


@query("""WITH $LINES, h AS (SELECT DISTINCT n_regionkey AS team, year, week, split_part(o_orderpriority, '-', 1) || l_returnflag || l_linestatus AS pick FROM lines JOIN nation ON c_nationkey = n_nationkey WHERE qty >= 42),
o AS (SELECT split_part(o_orderpriority, '-', 1) || l_returnflag || l_linestatus AS pick, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lines) AS p FROM lines GROUP BY ALL),
w AS (SELECT team, year, count(DISTINCT week) AS weeks FROM h GROUP BY ALL),
c AS (SELECT a.team, a.year, 2 AS size, [a.pick, b.pick] AS items FROM h a JOIN h b USING (team, year, week) WHERE a.pick < b.pick
  UNION ALL SELECT a.team, a.year, 3, [a.pick, b.pick, c.pick] FROM h a JOIN h b USING (team, year, week) JOIN h c USING (team, year, week) WHERE a.pick < b.pick AND b.pick < c.pick
  UNION ALL SELECT a.team, a.year, 4, [a.pick, b.pick, c.pick, d.pick] FROM h a JOIN h b USING (team, year, week) JOIN h c USING (team, year, week) JOIN h d USING (team, year, week) WHERE a.pick < b.pick AND b.pick < c.pick AND c.pick < d.pick),
n AS (SELECT team, year, size, items, count(*) AS together FROM c GROUP BY ALL HAVING count(*) >= 4)
SELECT CAST(n.team AS INTEGER) AS team, n.year, size, array_to_string(items, '/') AS items, together, round(CAST(together AS DOUBLE) / any_value(weeks), 6) AS joint_rate, round(1 - product(1 - p), 6) AS market_probability
FROM (SELECT *, unnest(items) AS pick FROM n) n JOIN o ON o.pick = n.pick JOIN w ON w.team = n.team AND w.year = n.year GROUP BY n.team, n.year, size, items, together""")
def selection_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to four selections that hit in one week at least four times in a year, with what odds make of them."""
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").cast("int").alias("team"))
    pick = F.concat(F.substring_index("o_orderpriority", "-", 1), "l_returnflag", "l_linestatus")
    lines = order_lines(spark, sf_dir).withColumn("pick", pick)
    hits = lines.filter("l_quantity >= 42").join(nations, "o_custkey").select("team", "year", "week", "pick")
    odds = lines.groupBy("pick").agg(F.count("*").alias("n"))
    odds = odds.crossJoin(F.broadcast(odds.agg(F.sum("n").alias("all")))).select("pick", (F.col("n").cast("double") / F.col("all")).alias("p"))  # one row
    found = selections.combinations(hits, ["team", "year"], "pick", "week", 4, 4)
    weeks = hits.groupBy("team", "year").agg(F.count_distinct("week").alias("weeks"))
    # Odds by selection are a few dozen rows: one map of them serves every combination.
    priced = found.crossJoin(F.broadcast(odds.agg(F.map_from_entries(F.collect_list(F.struct("pick", "p"))).alias("odds"))))
    market = selections.combined_probability(F.transform("items", lambda i: F.element_at("odds", i)))
    return priced.join(weeks, ["team", "year"]).select("team", "year", "size", F.array_join("items", "/").alias("items"), "together", F.round(F.col("together").cast("double") / F.col("weeks"), 6).alias("joint_rate"), F.round(market, 6).alias("market_probability"))


LEGS = """legs AS (SELECT l_orderkey AS wager, l_partkey AS leg, 1 + CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 16 AS odds, CASE l_returnflag WHEN 'R' THEN 'LOST' WHEN 'A' THEN CASE l_linestatus WHEN 'O' THEN 'PUSH' ELSE 'WON' END ELSE CASE l_linestatus WHEN 'O' THEN 'WON' END END AS state,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), paid AS (SELECT *, CASE state WHEN 'WON' THEN odds WHEN 'PUSH' THEN 1.0 ELSE 0.0 END AS got FROM legs)"""


def wager_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as legs of their order's wager; odds are sixteenths, so products and sums are exact."""
    settled = F.when(F.col("l_returnflag") == "R", "LOST").when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "PUSH").otherwise("WON")).when(F.col("l_linestatus") == "O", "WON")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("wager"), F.col("l_partkey").alias("leg"), (1 + F.col("l_quantity").cast("long").cast("double") / 16).alias("odds"), settled.alias("state"))


@query(f"""WITH {LEGS}, c AS (
  SELECT wager, 2 AS size, a.odds * b.odds AS potential, a.got * b.got AS got FROM paid a JOIN paid b USING (wager) WHERE a.i < b.i
  UNION ALL SELECT wager, 3, a.odds * b.odds * c.odds, a.got * b.got * c.got FROM paid a JOIN paid b USING (wager) JOIN paid c USING (wager) WHERE a.i < b.i AND b.i < c.i
  UNION ALL SELECT wager, 4, a.odds * b.odds * c.odds * d.odds, a.got * b.got * c.got * d.got FROM paid a JOIN paid b USING (wager) JOIN paid c USING (wager) JOIN paid d USING (wager) WHERE a.i < b.i AND b.i < c.i AND c.i < d.i)
SELECT wager, size, count(*) AS parlays, sum(potential) AS potential, sum(got) AS returned FROM c GROUP BY ALL""")
def round_robin_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All two- to four-leg parlays of each wager; the SQL lists them."""
    return selections.round_robins(wager_legs(spark, sf_dir), "wager", "state", "odds", (2, 3, 4))


@query(f"""WITH {LEGS}, c AS (SELECT wager, unnest([a.leg, b.leg, c.leg]) AS leg, unnest([a.i, b.i, c.i]) AS i, a.odds * b.odds * c.odds AS potential FROM paid a JOIN paid b USING (wager) JOIN paid c USING (wager) WHERE a.i < b.i AND b.i < c.i)
SELECT leg, count(DISTINCT (wager, i)) AS wagers, count(*) AS parlays, sum(potential) AS potential FROM c GROUP BY leg""")
def leg_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each selection holds of all three-leg parlays."""
    return selections.exposures(wager_legs(spark, sf_dir), "wager", "leg", "odds", 3)


@query("""WITH w AS (SELECT l_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * count(*) / 2) AS BIGINT) - 100000 AS odds, count(*) FILTER (WHERE l_returnflag = 'R') AS lost_legs, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS open_legs, count(*) AS stake, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS potential
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_totalprice),
s AS (SELECT *, CASE WHEN lost_legs > 0 THEN 'LOST' WHEN open_legs > 0 THEN 'OPEN' ELSE 'WON' END AS result, CASE WHEN odds < 100 THEN 'under_100' WHEN odds < 400 THEN 'range_100_400' WHEN odds < 1000 THEN 'range_400_1000' WHEN odds < 10000 THEN 'range_1000_10000' WHEN odds < 50000 THEN 'range_10000_50000' WHEN odds < 100000 THEN 'range_50000_100000'
  WHEN odds < 150000 THEN 'range_100000_150000' WHEN odds < 250000 THEN 'range_150000_250000' WHEN odds < 500000 THEN 'range_250000_500000' WHEN odds < 1000000 THEN 'range_500000_1000000' ELSE 'over_1000000' END AS odds_range FROM w)
SELECT odds_range, count(*) AS wagers, count(*) FILTER (WHERE result = 'WON') AS won, count(*) FILTER (WHERE result = 'LOST') AS lost, count(*) FILTER (WHERE result = 'OPEN') AS open, CAST(sum(stake) AS BIGINT) AS risk, CAST(coalesce(sum(potential) FILTER (WHERE result = 'WON'), 0) AS DOUBLE) AS returned, max(odds) AS highest,
  count(*) FILTER (WHERE result = 'LOST' AND lost_legs = 1) AS lost_by_one FROM s GROUP BY odds_range""")
def wagers_by_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    made = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").groupBy("l_orderkey", "price").agg(
        count(F.col("l_returnflag") == "R").alias("lost_legs"), count((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("open_legs"), F.count("*").alias("stake"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("potential")
    )
    result = F.when(F.col("lost_legs") > 0, "LOST").when(F.col("open_legs") > 0, "OPEN").otherwise("WON")
    wagers = made.withColumns({"odds": F.round(F.col("price") * F.col("stake") / 2).cast("long") - 100_000, "result": result})
    return selections.wager_summary(wagers, "odds", "result", "lost_legs", "stake", "potential").withColumn("returned", F.col("returned").cast("double"))

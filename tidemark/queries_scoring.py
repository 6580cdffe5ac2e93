"""Registered queries on points, values, prices and standings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scalar
from tidemark.operators import ordered, scoring, standings, valuation
from tidemark.registry import query
from tidemark.sources.star import order_lines, table
from tidemark.storage import Workspace

#: Seasons of customers, in SQL and below: points of a year with their position.
SEASONS = """pts AS (SELECT year, o_custkey, c_mktsegment, sum(price) AS points FROM lines JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    lines = order_lines(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return lines.groupBy("year", "o_custkey", "c_mktsegment").agg(F.sum("l_extendedprice").alias("points"))


@query("""WITH $LINES SELECT l_suppkey, CAST(sum(coalesce(qty, 0) * CASE WHEN l_returnflag = 'R' THEN 0.25 ELSE 0.1 END + coalesce(price, 0) * 0.01 + coalesce(disc, 0) * -2) AS DOUBLE) AS points, count(*) AS n FROM lines GROUP BY ALL""")
def format_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = scoring.points({"l_quantity": "0.1", "l_extendedprice": "0.01", "l_discount": "-2"}, {"R": {"l_quantity": "0.25"}}, F.col("l_returnflag"))
    return order_lines(spark, sf_dir).groupBy("l_suppkey").agg(F.sum(worth).cast("double").alias("points"), F.count("*").alias("n"))


@query("""WITH $LINES, g AS (SELECT o_custkey, year, o_orderkey, sum(price) AS t, count(*) FILTER (WHERE price >= 40000) AS big FROM lines GROUP BY ALL)
SELECT o_custkey, year, CAST(sum(t * 0.04 + CASE WHEN t >= 100000 THEN 3 ELSE 0 END + CASE WHEN t >= 200000 THEN 2.5 ELSE 0 END + big * 1.5) AS DOUBLE) AS points, count(*) AS games FROM g GROUP BY ALL""")
def milestone_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.season_points(order_lines(spark, sf_dir), ["o_custkey", "year"], "o_orderkey", "l_extendedprice", "0.04", [(100000, "3"), (200000, "2.5")], (40000, "1.5"))
    return made.withColumn("points", F.col("points").cast("double"))


@query("""WITH $LINES SELECT l_suppkey, CAST(sum(CASE WHEN qty <= 19 THEN 3 WHEN qty <= 39 THEN 3.5 ELSE 5 END + 0.1 * greatest(qty, 30)) AS DOUBLE) AS points FROM lines GROUP BY ALL""")
def banded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = scoring.banded(F.col("l_quantity"), [(19, "3"), (39, "3.5"), (0, "5")], "0.1", 30)
    return order_lines(spark, sf_dir).groupBy("l_suppkey").agg(F.sum(worth).cast("double").alias("points"))


@query("""WITH $LINES, v AS (SELECT l_partkey, max(price) FILTER (WHERE l_returnflag = 'A') AS a, max(price) FILTER (WHERE l_returnflag = 'N') AS n, max(price) FILTER (WHERE l_returnflag = 'R') AS r FROM lines GROUP BY ALL),
w AS (SELECT *, (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN n IS NULL THEN 0 ELSE 0.3 END + CASE WHEN r IS NULL THEN 0 ELSE 0.2 END)::DOUBLE AS w FROM v)
SELECT l_partkey, CAST(round(CAST((coalesce(a * 0.5, 0) + coalesce(n * 0.3, 0) + coalesce(r * 0.2, 0)) / nullif(w, 0) AS DECIMAL(30,6)), 2) AS DOUBLE) AS blended, round(w, 6) AS coverage FROM w""")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))).alias(flag.lower())
    parts = order_lines(spark, sf_dir).groupBy("l_partkey").agg(*map(flagged, "ANR"))
    value, coverage = scoring.blend({"a": "0.5", "n": "0.3", "r": "0.2"})
    return parts.select("l_partkey", F.round(value, 2).cast("double").alias("blended"), F.round(coverage, 6).cast("double").alias("coverage"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS spent,
count(*) FILTER (WHERE event_type IN ('view', 'click')) AS looks, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type IN ('error', 'signup')) AS DOUBLE) AS other FROM events GROUP BY ALL""")
def coded_stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"purchases": (("purchase",), False), "spent": (("purchase",), True), "looks": (("view", "click"), False), "other": (("error", "signup"), True)}
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return scoring.stat_lines(events, ["user_id"], "event_type", "value", rules).withColumns({c: F.col(c).cast("double") for c in ("spent", "other")})


@query("""WITH $LINES SELECT l_suppkey, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad, count(*) FILTER (WHERE ok IS NULL) AS unknown
FROM (SELECT l_suppkey, qty >= 30 * CASE l_linenumber WHEN 1 THEN 0.4 WHEN 2 THEN 0.6 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 END AS ok FROM lines) GROUP BY ALL""")
def success_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = scoring.success(F.col("l_quantity").cast("double"), F.lit(30.0), F.col("l_linenumber"))
    count = lambda c: F.count(F.when(c, 1))
    return order_lines(spark, sf_dir).withColumn("ok", ok).groupBy("l_suppkey").agg(count(F.col("ok")).alias("good"), count(~F.col("ok")).alias("bad"), count(F.col("ok").isNull()).alias("unknown"))


ROSTER = """WITH $LINES, """ + SEASONS + """, p AS (SELECT *, row_number() OVER (PARTITION BY year, c_mktsegment ORDER BY points DESC, o_custkey) AS r FROM pts),
f AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY points DESC, o_custkey) AS x FROM p WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND r > CASE c_mktsegment WHEN 'BUILDING' THEN 4 ELSE 3 END),
s AS (SELECT year, o_custkey, c_mktsegment, points, c_mktsegment AS slot FROM p WHERE r <= CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 3 WHEN 'FURNITURE' THEN 2 ELSE 0 END
UNION ALL SELECT year, o_custkey, c_mktsegment, points, 'FLEX' FROM f WHERE x <= 3)"""
SLOTS, FLEXIBLE = {"BUILDING": 4, "MACHINERY": 3, "FURNITURE": 2}, (("BUILDING", "MACHINERY"), 3)


@query(ROSTER + " SELECT year, o_custkey, c_mktsegment, CAST(points AS DOUBLE) AS points, slot FROM s")
def roster_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = valuation.starters(seasons(spark, sf_dir), ["year"], "c_mktsegment", "points", "o_custkey", SLOTS, FLEXIBLE)
    return chosen.withColumn("points", F.col("points").cast("double"))


@query(ROSTER + """, b AS (SELECT year, c_mktsegment, min(points) AS baseline FROM s GROUP BY ALL), v AS (SELECT pts.*, points - baseline AS added FROM pts LEFT JOIN b USING (year, c_mktsegment)),
t AS (SELECT year, sum(added) FILTER (WHERE added > 0) AS surplus FROM v GROUP BY ALL)
SELECT year, o_custkey, c_mktsegment, CAST(added AS DOUBLE) AS added, greatest(round(1000.0::DOUBLE / nullif(CAST(surplus AS DOUBLE), 0) * CAST(added AS DOUBLE)), 0.0) + 0.0 AS price FROM v JOIN t USING (year)""")
def values_and_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = seasons(spark, sf_dir)
    chosen = valuation.starters(pool, ["year"], "c_mktsegment", "points", "o_custkey", SLOTS, FLEXIBLE)
    valued = valuation.points_added(pool, valuation.baselines(chosen, ["year"], "c_mktsegment", "points"), ["year"], "c_mktsegment", "points")
    return valuation.priced(valued, ["year"], 1000.0).select("year", "o_custkey", "c_mktsegment", F.col("added").cast("double").alias("added"), "price")


@query("""WITH p AS (SELECT c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE'))
SELECT c_mktsegment, round(CAST(sum(v) AS DOUBLE) / count(*), 2) AS average, count(*) AS n FROM p WHERE r <= CASE c_mktsegment WHEN 'BUILDING' THEN 10 ELSE 5 END GROUP BY ALL""")
def tag_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"))
    return valuation.top_average(customers, ["c_mktsegment"], "c_acctbal", {"BUILDING": 10, "FURNITURE": 5}, "c_mktsegment").withColumn("average", F.round("average", 2))


@query("""WITH $LINES, w AS (SELECT year, week, c_nationkey AS team, sum(price) AS score FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL)
SELECT a.year, a.week, a.team, CAST(any_value(a.score) AS DOUBLE) AS score, count(*) FILTER (WHERE b.score < a.score) AS ap_wins, count(*) FILTER (WHERE b.score > a.score) AS ap_losses, count(*) FILTER (WHERE b.score = a.score AND b.team <> a.team) AS ap_ties
FROM w a JOIN w b USING (year, week) GROUP BY ALL""")
def all_play_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = standings.all_play(team_weeks(spark, sf_dir), ["year", "week"], "score")
    return made.withColumn("score", F.col("score").cast("double"))


def team_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("team"))
    lines = order_lines(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return lines.filter("team is not null").groupBy("year", "week", "team").agg(F.sum("l_extendedprice").alias("score"))


@query("""WITH $LINES, w AS (SELECT year, week, c_nationkey AS team, sum(price) AS score FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL),
m AS (SELECT DISTINCT year, week, n.n_nationkey AS home, n.n_nationkey + 1 AS away FROM w, nation n WHERE n.n_nationkey % 2 = 0 AND n.n_nationkey < 24),
g AS (SELECT year, week, home AS team, away AS opp FROM m UNION ALL SELECT year, week, away, home FROM m),
r AS (SELECT g.year, g.team, coalesce(a.score, 0) AS s, coalesce(b.score, 0) AS o FROM g LEFT JOIN w a ON a.year = g.year AND a.week = g.week AND a.team = g.team LEFT JOIN w b ON b.year = g.year AND b.week = g.week AND b.team = g.opp),
t AS (SELECT year, team, n_regionkey, count(*) FILTER (WHERE s > o) AS wins, count(*) FILTER (WHERE s < o) AS losses, count(*) FILTER (WHERE s = o) AS ties, sum(s) AS pf, sum(o) AS pa, round(stddev_pop(CAST(s AS DOUBLE)), 2) AS deviation FROM r JOIN nation ON team = n_nationkey GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY year, n_regionkey ORDER BY wins DESC, ties DESC, pf DESC, team) = 1 AS division_winner FROM t)
SELECT year, CAST(team AS INTEGER) AS team, wins, losses, ties, CAST(pf AS DOUBLE) AS points_for, CAST(pa AS DOUBLE) AS points_against, deviation, division_winner,
row_number() OVER (PARTITION BY year ORDER BY division_winner DESC, wins DESC, ties DESC, pf DESC, team) AS seed,
round(9 * (CAST(pf AS DOUBLE) - min(CAST(pf AS DOUBLE)) OVER y) / nullif(max(CAST(pf AS DOUBLE)) OVER y - min(CAST(pf AS DOUBLE)) OVER y, 0) + (CAST(wins AS DOUBLE) - min(CAST(wins AS DOUBLE)) OVER y) / nullif(max(CAST(wins AS DOUBLE)) OVER y - min(CAST(wins AS DOUBLE)) OVER y, 0), 4) AS draft_index
FROM d WINDOW y AS (PARTITION BY year)""")
def standings_and_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = team_weeks(spark, sf_dir)
    nations = table(spark, sf_dir, "nation")
    homes = nations.filter("n_nationkey % 2 = 0 and n_nationkey < 24").select(F.col("n_nationkey").alias("home"), (F.col("n_nationkey") + 1).alias("away"))
    matchups = scores.select("year", "week").distinct().crossJoin(F.broadcast(homes))  # the fixed dimension of nations
    games = standings.head_to_head(scores, matchups, ["year", "week"], "team", "score")
    standing = standings.records(games, ["year", "team"], "score").join(nations.select(F.col("n_nationkey").alias("team"), "n_regionkey"), "team")
    standing = standings.draft_order_index(standings.seeded(standing, ["year"], "n_regionkey", "team"), ["year"], "points_for", "wins")
    money = {c: F.col(c).cast("double") for c in ("points_for", "points_against")}
    return standing.withColumns(money | {"deviation": F.round("deviation", 2), "draft_index": F.round("draft_index", 4)}).drop("n_regionkey", "high", "low")


PLAYOFFS = standings.PlayoffRules(10, 2, bye_pool="division_winners", bye_by="all_play", at_large_by="points", division_berths=True, record_berths=2)


@query("""WITH $LINES, w AS (SELECT year, week, c_nationkey AS team, sum(price) AS score FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL),
m AS (SELECT DISTINCT year, week, n.n_nationkey AS home, n.n_nationkey + 1 AS away FROM w, nation n WHERE n.n_nationkey % 2 = 0 AND n.n_nationkey < 24), g AS (SELECT year, week, home AS team, away AS opp FROM m UNION ALL SELECT year, week, away, home FROM m),
r AS (SELECT g.year, g.team, coalesce(a.score, 0) AS s, coalesce(b.score, 0) AS o FROM g LEFT JOIN w a ON a.year = g.year AND a.week = g.week AND a.team = g.team LEFT JOIN w b ON b.year = g.year AND b.week = g.week AND b.team = g.opp),
p AS (SELECT a.year, a.team, count(*) FILTER (WHERE b.score < a.score) AS aw, count(*) FILTER (WHERE b.score > a.score) AS al, count(*) FILTER (WHERE b.score = a.score AND b.team <> a.team) AS at FROM w a JOIN w b USING (year, week) GROUP BY ALL),
t AS (SELECT year, team, n_regionkey AS division, count(*) FILTER (WHERE s > o) AS wins, count(*) FILTER (WHERE s < o) AS losses, count(*) FILTER (WHERE s = o) AS ties, sum(s) AS pf FROM r JOIN nation ON team = n_nationkey GROUP BY ALL),
a AS (SELECT t.*, (aw + p.at / 2) / nullif(aw + al + p.at, 0) AS ap, row_number() OVER (PARTITION BY t.year ORDER BY wins DESC, losses, ties DESC, (aw + p.at / 2) / nullif(aw + al + p.at, 0) DESC, pf DESC, t.team) AS rec FROM t JOIN p ON p.year = t.year AND p.team = t.team),
b AS (SELECT *, rec = min(rec) OVER (PARTITION BY year, division) AS winner FROM a), c AS (SELECT *, CASE WHEN winner THEN row_number() OVER (PARTITION BY year, winner ORDER BY ap DESC, pf DESC, team) END AS bye_place FROM b),
d AS (SELECT *, CASE WHEN bye_place <= 2 THEN 'bye' WHEN winner THEN 'division' END AS sure FROM c), e AS (SELECT *, CASE WHEN sure IS NULL THEN row_number() OVER (PARTITION BY year, sure IS NULL ORDER BY rec) END AS k FROM d),
f AS (SELECT *, CASE WHEN sure IS NULL AND k > 2 THEN row_number() OVER (PARTITION BY year, sure IS NULL AND k > 2 ORDER BY pf DESC, ap DESC, team) END AS l FROM e),
h AS (SELECT *, CASE WHEN sure IS NOT NULL THEN sure WHEN k <= 2 THEN 'record' WHEN l <= 10 - 2 - (count(*) FILTER (WHERE sure IS NOT NULL) OVER (PARTITION BY year)) THEN 'at_large' END AS berth FROM f)
SELECT year, CAST(team AS INTEGER) AS team, winner AS division_winner, berth, row_number() OVER (PARTITION BY year ORDER BY CASE WHEN berth = 'bye' THEN 0 WHEN berth IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN berth = 'bye' THEN bye_place ELSE 0 END, rec) AS seed FROM h""")
def playoff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byes, sure places, places by record and at large of each year, and all seeds."""
    scores = Workspace(spark, "playoffs").save(team_weeks(spark, sf_dir), "weeks")
    nations = table(spark, sf_dir, "nation")
    homes = nations.filter("n_nationkey % 2 = 0 and n_nationkey < 24").select(F.col("n_nationkey").alias("home"), (F.col("n_nationkey") + 1).alias("away"))
    matchups = scores.select("year", "week").distinct().crossJoin(F.broadcast(homes))  # the fixed dimension of nations
    records = standings.records(standings.head_to_head(scores, matchups, ["year", "week"], "team", "score"), ["year", "team"], "score")
    against_all = standings.all_play(scores, ["year", "week"], "score").groupBy("year", "team").agg(*[F.sum(c).alias(c) for c in ("ap_wins", "ap_losses", "ap_ties")])
    league = records.join(against_all, ["year", "team"]).join(nations.select(F.col("n_nationkey").alias("team"), "n_regionkey"), "team")
    field = standings.playoff_field(league, ["year"], "n_regionkey", "team", PLAYOFFS)
    return field.select("year", F.col("team").cast("int").alias("team"), "division_winner", "berth", "seed")


@query("""WITH $LINES, """ + SEASONS + """, w AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY points DESC, o_custkey) AS r, count(*) OVER (PARTITION BY year) AS n FROM pts)
SELECT year, o_custkey, CAST((r - 1) * 5 // n AS INTEGER) AS band FROM w""")
def rank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = Workspace(spark, "rank_bands").save(seasons(spark, sf_dir).withColumn("falling", -F.col("points")), "seasons")
    placed = ordered.row_numbers(pool, ["year"], ["falling", "o_custkey"], "r")
    placed = placed.join(F.broadcast(pool.groupBy("year").agg(F.count("*").alias("n"))), "year")  # a row for each year
    return placed.select("year", "o_custkey", scalar.rank_band(F.col("r"), F.col("n"), 5).alias("band"))


@query("""WITH $LINES, w AS (SELECT year, week, o_custkey, sum(price) AS p FROM lines WHERE year = 1996 GROUP BY ALL), a AS (SELECT week, quantile_disc(p, 0.5) AS b FROM w GROUP BY ALL)
SELECT o_custkey, CAST(sum(p - b) FILTER (WHERE p > b AND week >= 20) AS DOUBLE) AS rest_positive, CAST(sum(p - b) FILTER (WHERE week >= 20) AS DOUBLE) AS rest_net FROM w JOIN a USING (week) GROUP BY ALL""")
def rest_of_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = order_lines(spark, sf_dir).filter("year = 1996").groupBy("week", "o_custkey").agg(F.sum("l_extendedprice").alias("p"))
    weeks = Workspace(spark, "rest_of_season").save(weeks, "weeks")
    middle = ordered.quantiles(weeks, ["week"], "p", {"b": (0.5, "disc")})
    added = weeks.join(F.broadcast(middle), "week").withColumn("added", F.col("p") - F.col("b"))
    later = F.col("week") >= 20
    return added.groupBy("o_custkey").agg(F.sum(F.when(later & (F.col("added") > 0), F.col("added"))).cast("double").alias("rest_positive"), F.sum(F.when(later, F.col("added"))).cast("double").alias("rest_net"))


@query("""WITH $LINES, s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE qty >= 40) AS q FROM lines GROUP BY ALL)
SELECT o_custkey, CASE WHEN n < 10 THEN 'unknown' WHEN r * 1.0 / n >= 0.4 THEN 'returner' WHEN q * 1.0 / n >= 0.3 THEN 'bulk' ELSE 'regular' END AS archetype, least(round(r * 100.0::DOUBLE / n, 2), 999.99::DOUBLE) AS share FROM s""")
def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    shares = order_lines(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"), count(F.col("l_returnflag") == "R").alias("r"), count(F.col("l_quantity") >= 40).alias("q"))
    kind = F.when(F.col("n") < 10, "unknown").when(F.col("r") / F.col("n") >= 0.4, "returner").when(F.col("q") / F.col("n") >= 0.3, "bulk").otherwise("regular")
    return shares.select("o_custkey", kind.alias("archetype"), scalar.share_percent(F.col("r"), F.col("n")).alias("share"))

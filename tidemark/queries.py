"""Registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark import queries_asof, queries_attach, queries_columns, queries_enrichment, queries_gamelogs, queries_history, queries_lineage, queries_live, queries_maintained, queries_measures, queries_more, queries_player, queries_plays, queries_rates, queries_scoring, queries_selections, queries_settlement, queries_signals  # noqa: F401  (registers their queries)
from tidemark.functions import scalar
from tidemark.operators import history, joins, lineage, ordered
from tidemark.plans.model import Filter, Output, ViewColumn, ViewRequest
from tidemark.plans.view import option_counts, plan_view
from tidemark.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  (the first two are read from here)
from tidemark.sources.star import order_lines, star_catalog, table
from tidemark.storage import Workspace
from tidemark.streaming import windows


@query("""WITH $LINES, y AS (SELECT unnest([1995, 1996]) AS year), s AS (SELECT c_custkey AS subject, CAST(year AS INTEGER) AS year, c_name, c_mktsegment FROM customer, y WHERE c_mktsegment = 'BUILDING'),
m AS (SELECT o_custkey AS subject, year, CAST(sum(price) AS DOUBLE) AS revenue_0, round(100.0 * CAST(sum(price * disc) AS DOUBLE) / nullif(CAST(sum(price) AS DOUBLE), 0), 2) AS discount_share_0
      FROM lines WHERE year IN (1995, 1996) AND l_returnflag = 'R' GROUP BY ALL),
g AS (SELECT o_custkey AS subject, year, count(DISTINCT o_orderkey) AS games FROM lines WHERE year IN (1995, 1996) GROUP BY ALL)
SELECT s.*, revenue_0, discount_share_0, round(revenue_0 / nullif(games, 0), 4) AS revenue_1 FROM s LEFT JOIN m USING (subject, year) LEFT JOIN g USING (subject, year)
ORDER BY revenue_0 DESC NULLS LAST, subject, year LIMIT 500""")
def view_customer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = (Filter("l_returnflag", "IN", ("R",)),)
    request = ViewRequest(
        columns=(ViewColumn("revenue", filters=returned), ViewColumn("discount_share", filters=returned), ViewColumn("revenue", Output("rate", "game"), returned)),
        axes=("year",), years=(1995, 1996), where=(Filter("c_mktsegment", "=", "BUILDING"),), sort=(("revenue_0", True),),
    )
    return plan_view(star_catalog(spark, sf_dir), request)


@query("""WITH $LINES SELECT n_nationkey AS subject, n_name, r_name, CAST(sum(price) AS DOUBLE) AS revenue_0,
round(CAST(sum(price) AS DOUBLE) / nullif(count(DISTINCT o_orderkey), 0), 4) AS revenue_1,
round(CAST(sum(price) AS DOUBLE) / nullif(count(DISTINCT (o_orderkey, l_suppkey)), 0), 4) AS revenue_2,
round(CAST(sum(price) AS DOUBLE) / nullif(count(DISTINCT (o_orderkey, l_returnflag)), 0), 4) AS revenue_3,
round(CAST(sum(price) AS DOUBLE) / nullif(count(DISTINCT year), 0), 4) AS revenue_4, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS parts_0
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN lines ON c_nationkey = n_nationkey GROUP BY ALL""")
def view_team_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = tuple(ViewColumn("revenue", Output("rate", unit)) for unit in ("game", "series", "drive", "season"))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest((ViewColumn("revenue"), *rates, ViewColumn("parts")), grain="team", limit=None))


@query("""WITH $LINES, p AS (SELECT o_custkey AS subject, o_orderkey, CAST(sum(price) AS DOUBLE) AS v, round(CAST(sum(qty) AS DOUBLE) / count(l_linenumber), 4) AS q FROM lines GROUP BY ALL),
a AS (SELECT subject, count(*) FILTER (WHERE v >= 100000) AS revenue_0, round(avg(v), 8) AS revenue_1, round(avg(q), 8) AS mean_quantity_0 FROM p GROUP BY ALL)
SELECT c_custkey AS subject, c_name, c_mktsegment, revenue_0, revenue_1, mean_quantity_0 FROM customer LEFT JOIN a ON subject = c_custkey WHERE revenue_0 > 0""")
def view_period_counts_and_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (ViewColumn("revenue", Output("count", "game", (">=", 100000))), ViewColumn("revenue", Output("mean", "game")), ViewColumn("mean_quantity", Output("mean", "game")))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(columns, having=(Filter("revenue_0", ">", 0),), limit=None))


@query("""WITH $LINES, y AS (SELECT c_nationkey AS subject, year, sum(price) AS g, sum(price * disc) AS d FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL),
s AS (SELECT n_nationkey AS subject, n_name, r_name, CAST(year AS INTEGER) AS year FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1996, 1997]) AS year))
SELECT s.subject, s.year, n_name, r_name, CAST(sum(g) AS DOUBLE) AS revenue_0, round(100.0 * CAST(sum(d) AS DOUBLE) / nullif(CAST(sum(g) AS DOUBLE), 0), 2) AS discount_share_0
FROM s LEFT JOIN y ON y.subject = s.subject AND y.year BETWEEN s.year - 2 AND s.year - 1 GROUP BY ALL""")
def view_year_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (ViewColumn("revenue", year_offset=(-2, -1)), ViewColumn("discount_share", year_offset=(-2, -1)))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(columns, grain="team", axes=("year",), years=(1996, 1997), limit=None))


@query("""WITH $LINES SELECT 'returned' AS option, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lines WHERE year BETWEEN 1995 AND 1996
UNION ALL SELECT 'small', count(*) FILTER (WHERE qty BETWEEN 1 AND 10 AND disc >= 0.05) FROM lines WHERE year BETWEEN 1995 AND 1996
UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority ILIKE '%urg%') FROM lines WHERE year BETWEEN 1995 AND 1996""")
def preset_option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {"returned": (Filter("l_returnflag", "=", "R"),), "small": (Filter("l_quantity", "BETWEEN", (10, 1)), Filter("l_discount", ">=", 0.05)), "urgent": (Filter("o_orderpriority", "ILIKE", "urg"),)}
    return option_counts(star_catalog(spark, sf_dir), (Filter("year", "BETWEEN", (1995, 1996)),), options)


@query("""WITH $LINES, n AS (SELECT o_custkey, year, s_nationkey, count(*) AS n FROM lines JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT o_custkey, year, s_nationkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY n DESC, s_nationkey) AS r FROM n) WHERE r = 1""")
def bridge_mode_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joins.mode_per_key(lines, ["o_custkey", "year"], "s_nationkey")


@query("""WITH $LINES, u AS (SELECT 'customer' AS role, o_custkey AS subject, price, disc FROM lines UNION ALL SELECT 'supplier', l_suppkey, price, disc FROM lines UNION ALL SELECT 'part', l_partkey, price, disc FROM lines)
SELECT role, subject, CAST(sum(price * disc) AS DOUBLE) AS points, count(*) AS n FROM u GROUP BY ALL HAVING sum(price * disc) > 0""")
def multi_role_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.role_union(order_lines(spark, sf_dir), {"customer": "o_custkey", "supplier": "l_suppkey", "part": "l_partkey"}, ["l_extendedprice", "l_discount"])
    points = rows.groupBy("role", "subject").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("points"), F.count("*").alias("n"))
    return points.filter("points > 0").withColumn("points", F.col("points").cast("double"))


@query("""WITH $LINES, t AS (SELECT o_orderkey, sum(price) AS team FROM lines GROUP BY ALL), m AS (SELECT l_suppkey, o_orderkey, sum(price) AS own FROM lines GROUP BY ALL)
SELECT l_suppkey, round(CAST(sum(own) AS DOUBLE) / CAST(sum(team) AS DOUBLE), 6) AS share, count(*) AS games FROM m JOIN t USING (o_orderkey) GROUP BY ALL""")
def cohort_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir)
    own = lines.groupBy("l_suppkey", "o_orderkey").agg(F.sum("l_extendedprice").alias("own"))
    both = own.withColumn("team", F.sum("own").over(Window.partitionBy("o_orderkey")))
    shares = both.groupBy("l_suppkey").agg(F.sum("own").alias("own"), F.sum("team").alias("team"), F.count("*").alias("games"))
    return shares.select("l_suppkey", F.round(F.col("own").cast("double") / F.col("team").cast("double"), 6).alias("share"), "games")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' OR event_type = 'click' GROUP BY ALL)
SELECT p.event_id, p.user_id, p.ts, CASE WHEN v.ts > p.ts - INTERVAL 7 DAY THEN v.ts END AS asof_seen_at, CASE WHEN v.ts > p.ts - INTERVAL 7 DAY THEN v.value END AS asof_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.filter("event_type in ('view', 'click')").select("user_id", F.col("ts").alias("seen_at"), "value")
    return joins.asof_join(buys, seen, ["user_id"], "ts", "seen_at", ["value"], within="7 days")


@query("""SELECT p.event_id, count(*) AS n, bool_or(e.event_type = 'error') AS any_error FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts - INTERVAL 48 HOUR AND p.ts + INTERVAL 3 HOUR
WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def interval_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    near = joins.interval_join(buys, events.select("user_id", F.col("ts").alias("seen_at"), F.col("event_type").alias("kind")), ["user_id"], "ts", "seen_at", 48, 3)
    return near.groupBy("event_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "error").alias("any_error"))


@query("""WITH $LINES, s AS (SELECT c_mktsegment, year, o_custkey, sum(price) AS points FROM lines JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT year, o_custkey, c_mktsegment, CAST(points AS DOUBLE) AS points, rank() OVER (PARTITION BY year ORDER BY points DESC) AS overall_rank, rank() OVER (PARTITION BY year, c_mktsegment ORDER BY points DESC) AS position_rank FROM s""")
def season_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    points = lines.groupBy("year", "o_custkey", "c_mktsegment").agg(F.sum("l_extendedprice").alias("points"))
    points = Workspace(spark, "season_ranks").save(points, "points")
    ranked = ordered.competition_ranks(ordered.competition_ranks(points, ["year"], "points", "overall_rank"), ["year", "c_mktsegment"], "points", "position_rank")
    return ranked.withColumn("points", F.col("points").cast("double"))


@query("""WITH $LINES, s AS (SELECT o_custkey, year, sum(price) AS p FROM lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year) AS season, rank() OVER (PARTITION BY year ORDER BY p DESC) AS rk FROM s)
SELECT o_custkey, CAST(sum(p) AS DOUBLE) AS total, CAST(max(p) AS DOUBLE) AS best, CAST(sum(p) FILTER (WHERE season <= 3) AS DOUBLE) AS first_three, CAST(max(p) FILTER (WHERE season = 2) AS DOUBLE) AS second, count(*) FILTER (WHERE rk <= 12) AS top_twelve FROM r GROUP BY ALL""")
def career_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = order_lines(spark, sf_dir).groupBy("o_custkey", "year").agg(F.sum("l_extendedprice").alias("p"))
    ranked = ordered.competition_ranks(Workspace(spark, "career_log").save(seasons, "seasons"), ["year"], "p", "rk").withColumn("season", F.row_number().over(Window.partitionBy("o_custkey").orderBy("year")))
    cell = lambda c: c.cast("double")
    return ranked.groupBy("o_custkey").agg(
        cell(F.sum("p")).alias("total"), cell(F.max("p")).alias("best"), cell(F.sum(F.when(F.col("season") <= 3, F.col("p")))).alias("first_three"),
        cell(F.max(F.when(F.col("season") == 2, F.col("p")))).alias("second"), F.count(F.when(F.col("rk") <= 12, 1)).alias("top_twelve"),
    )


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS career_game, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS career_year FROM orders""")
def career_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("career_game"), F.dense_rank().over(own.orderBy(F.year("o_orderdate"))).cast("long").alias("career_year"))


@query("""WITH c AS (SELECT *, CASE WHEN lag(l_suppkey) OVER w IS DISTINCT FROM l_suppkey THEN 1 ELSE 0 END AS edge FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(edge) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drive FROM c""")
def drive_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = table(spark, sf_dir, "lineitem").withColumn("edge", (~F.lag("l_suppkey").over(order).eqNullSafe(F.col("l_suppkey"))).cast("long"))
    return edges.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum("edge").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("drive"))


@query("""SELECT o_custkey, o_orderkey, round(avg(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS last_five, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS games FROM orders""")
def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.avg(price).over(own.rowsBetween(-5, -1)), 6).alias("last_five"), F.count("*").over(own.rowsBetween(-10, -1)).alias("games"))


@query("""SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank_in_key FROM lineitem) WHERE rank_in_key <= 3""")
def top_three_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = joins.top_per_key(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"))
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank_in_key").cast("long").alias("rank_in_key"))


@query("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "ts", "event_type")


@query("""WITH v AS (SELECT p_brand, CAST(p_retailprice AS DOUBLE) AS v FROM part) SELECT p_brand, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, round(quantile_cont(v, 0.5), 4) AS median,
round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(stddev_pop(v), 4) AS sd_pop, round(least(stddev_samp(v) / nullif(avg(v), 0), 9.9999), 4) AS cv, min(v) AS low, max(v) AS high FROM v GROUP BY ALL""")
def percentiles_and_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_retailprice")
    parts = table(spark, sf_dir, "part")
    moments = parts.groupBy("p_brand").agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.round(F.stddev_pop(v), 4).alias("sd_pop"),
        F.round(F.least(F.try_divide(F.stddev_samp(v), F.avg(v)), F.lit(9.9999)), 4).alias("cv"), F.min(v).alias("low"), F.max(v).alias("high"),
    )
    points = ordered.quantiles(parts, ["p_brand"], "p_retailprice", {"p25": (0.25, "disc"), "p50": (0.5, "disc"), "p90": (0.9, "disc"), "median": (0.5, "cont")})
    return ordered.join_by(moments, points.withColumn("median", F.round("median", 4)), ["p_brand"], "left")


@query("""SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL""")
def correlation_and_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(history.correlation(x, y), 6).alias("r"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2")
    )


@query("""WITH $LINES, t AS (SELECT l_suppkey, o_custkey, sum(price) AS p FROM lines GROUP BY ALL), s AS (SELECT o_custkey, sum(p) AS total, count(*) AS n FROM t GROUP BY ALL)
SELECT l_suppkey, round(avg(CAST(p AS DOUBLE) - CAST(total - p AS DOUBLE) / nullif(n - 1, 0)), 2) AS adjusted FROM t JOIN s USING (o_custkey) GROUP BY ALL""")
def opponent_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = order_lines(spark, sf_dir).groupBy("l_suppkey", "o_custkey").agg(F.sum("l_extendedprice").alias("p"))
    totals = own.groupBy("o_custkey").agg(F.sum("p").alias("total"), F.count("*").alias("n"))
    other = F.try_divide((F.col("total") - F.col("p")).cast("double"), F.nullif(F.col("n") - 1, F.lit(0)))
    return own.join(totals, "o_custkey").groupBy("l_suppkey").agg(F.round(F.avg(F.col("p").cast("double") - other), 2).alias("adjusted"))


@query("""SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN 'active' WHEN n.k IS NOT NULL THEN 'bye' END AS status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996) o ON o.k = c_custkey
LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE year(o_orderdate) = 1996) n ON n.k = c_nationkey""")
def participation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1996)
    active = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    teams = customers.join(active, "c_custkey").select("c_nationkey").distinct().withColumn("team", F.lit(True))
    status = F.when(F.col("active"), "active").when(F.col("team"), "bye")
    return customers.join(active, "c_custkey", "left").join(teams, "c_nationkey", "left").select("c_custkey", status.alias("status"))


@query("""SELECT event_type, CAST(sum(CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':' || CAST(user_id AS VARCHAR)), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint, count(*) AS n FROM events GROUP BY event_type""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free sum of row hashes, so that each task sends one row for each type."""
    row = F.conv(F.substring(F.md5(F.concat_ws(":", "event_id", "user_id")), 1, 15), 16, 10).cast("decimal(38,0)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(row).cast("string").alias("fingerprint"), F.count("*").alias("n"))


@query("""SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance, round(CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)), 6) AS ratio
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"k{s}"), F.col("n_name").alias(s)) for s in "ab")
    return a.join(b, "n_regionkey").filter("ka < kb").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(scalar.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS v, avg(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE v > line) AS won, count(*) FILTER (WHERE v < line) AS lost, count(*) FILTER (WHERE line IS NULL) AS unsettled, round(count(*) FILTER (WHERE v > line) / nullif(CAST(count(line) AS DOUBLE), 0) - 0.5, 4) AS edge FROM s GROUP BY ALL""")
def market_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    settled = table(spark, sf_dir, "orders").withColumn("state", scalar.settle_over_under(price, F.avg(price).over(before), F.lit(True)))
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    return settled.groupBy("o_custkey").agg(
        count("WON").alias("won"), count("LOST").alias("lost"), F.count(F.when(F.col("state").isNull(), 1)).alias("unsettled"),
        F.round(F.try_divide(count("WON").cast("double"), F.nullif(F.count("state"), F.lit(0))) - scalar.implied_probability(scalar.american_to_decimal(F.lit(100))), 4).alias("edge"),
    )


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target, 0.5 AS share FROM orders), p AS (
SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth, CAST(1 AS DOUBLE) AS weight FROM orders UNION ALL SELECT root, e.target, depth + 1, weight * share FROM p JOIN e ON node = source WHERE e.target IS NOT NULL AND depth < 20) SELECT root, node, depth, weight FROM p""")
def lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(order).alias("target"), F.lit(0.5).alias("share"))
    return lineage.closure(orders.select(F.col("o_orderkey").alias("node")), edges)


@query("""WITH $LINES, b AS (SELECT l_returnflag, l_linestatus, year, week, price, qty, o_orderkey FROM lines WHERE qty BETWEEN 10 AND 40)
SELECT l_returnflag, l_linestatus, year, count(*) AS plays, count(DISTINCT o_orderkey) AS games, CAST(sum(price) AS DOUBLE) AS total, round(CAST(sum(price) AS DOUBLE) / count(*), 4) AS per_play FROM b GROUP BY ALL""")
def plays_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = order_lines(spark, sf_dir, most=2_000_000).filter(F.col("l_quantity").between(10, 40))
    total = F.sum("l_extendedprice").cast("double")
    return plays.groupBy("l_returnflag", "l_linestatus", "year").agg(F.count("*").alias("plays"), F.countDistinct("o_orderkey").alias("games"), total.alias("total"), F.round(total / F.count("*"), 4).alias("per_play"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drain(windows.tumbling_counts(windows.table_stream(spark, sf_dir)))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS edge FROM events),
s AS (SELECT user_id, ts, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = events.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")

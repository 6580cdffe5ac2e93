"""Registered queries on columns, filters, bridges and view parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import scalar
from tidemark.operators import joins
from tidemark.plans.model import Filter, Output, Presets, ViewColumn, ViewRequest
from tidemark.plans.view import plan_view
from tidemark.registry import query
from tidemark.sources.star import by_order, order_lines, star_catalog, table


@query("""WITH $LINES, y AS (SELECT c_nationkey AS subject, year AS f, CAST(sum(price) AS DOUBLE) AS g FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL),
s AS (SELECT n_nationkey AS subject, n_name, r_name, CAST(year AS INTEGER) AS year FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1996, 1997]) AS year))
SELECT s.subject, s.year, n_name, r_name, round(avg(g), 8) AS revenue_0, min(g) AS revenue_1, max(g) AS revenue_2, arg_max(g, f) AS revenue_3
FROM s LEFT JOIN y ON y.subject = s.subject AND f BETWEEN s.year - 2 AND s.year GROUP BY ALL""")
def view_offset_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = tuple(ViewColumn("revenue", year_offset=(-2, 0), offset_reduce=r) for r in ("avg", "min", "max", "latest"))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(columns, grain="team", axes=("year",), years=(1996, 1997), limit=None))


@query("""WITH $LINES, s AS (SELECT DISTINCT o_custkey, year FROM lines), cy AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year) AS n FROM s),
g AS (SELECT o_custkey, o_orderkey, min((year, week)) AS w FROM lines GROUP BY ALL), cg AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w, o_orderkey) AS n FROM g),
a AS (SELECT o_custkey, CAST(sum(price) AS DOUBLE) AS revenue_0 FROM lines JOIN cy USING (o_custkey, year) WHERE n BETWEEN 1 AND 2 GROUP BY ALL), b AS (SELECT o_custkey, CAST(sum(price) AS DOUBLE) AS revenue_1 FROM lines JOIN cg USING (o_custkey, o_orderkey) WHERE n BETWEEN 3 AND 6 GROUP BY ALL)
SELECT c_custkey AS subject, c_name, c_mktsegment, revenue_0, revenue_1 FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def view_career_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_view(star_catalog(spark, sf_dir), ViewRequest((ViewColumn("revenue", career_years=(1, 2)), ViewColumn("revenue", career_games=(3, 6))), limit=None))


@query("""WITH $LINES, s AS (SELECT n_nationkey AS subject, n_name, r_name, CAST(y AS INTEGER) AS year FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1995, 1996, 1997]) AS y)),
p AS (SELECT c_nationkey AS subject, CAST(sum(price) AS DOUBLE) AS revenue_0 FROM lines WHERE year = 1996 GROUP BY ALL), q AS (SELECT c_nationkey AS subject, year, CAST(sum(price) AS DOUBLE) AS revenue_1 FROM lines WHERE year IN (1995, 1996) GROUP BY ALL)
SELECT s.subject, s.year, n_name, r_name, revenue_0, revenue_1, count(*) OVER () AS total_count FROM s LEFT JOIN p USING (subject) LEFT JOIN q USING (subject, year) WHERE revenue_0 > 0 ORDER BY s.subject, s.year LIMIT 20 OFFSET 5""")
def view_pinned_years_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (ViewColumn("revenue", pinned_years=(1996,)), ViewColumn("revenue", pinned_years=(1995, 1996)))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(columns, grain="team", axes=("year",), years=(1995, 1996, 1997), having=(Filter("revenue_0", ">", 0),), offset=5, limit=20, with_count=True))


@query("""WITH $LINES, s AS (SELECT c_custkey AS subject, c_name, c_mktsegment, CAST(1996 AS INTEGER) AS year, week FROM customer, (SELECT DISTINCT week FROM lines WHERE year = 1996)), m AS (SELECT o_custkey AS subject, year, week, CAST(sum(price) AS DOUBLE) AS revenue_0, count(l_linenumber)::DOUBLE AS lines_0 FROM lines WHERE year = 1996 GROUP BY ALL)
SELECT s.*, revenue_0, lines_0 FROM s LEFT JOIN m USING (subject, year, week) WHERE lines_0 >= 3""")
def view_customer_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = ViewRequest((ViewColumn("revenue"), ViewColumn("lines")), axes=("year", "week"), years=(1996,), having=(Filter("lines_0", ">=", 3),), limit=None)
    return plan_view(star_catalog(spark, sf_dir), request)


@query("""WITH $LINES, p AS (SELECT c_nationkey AS subject, year AS k, CAST(sum(price) AS DOUBLE) AS v FROM lines WHERE c_nationkey IS NOT NULL GROUP BY ALL), a AS (SELECT subject, count(*) FILTER (WHERE v > 500000) AS revenue_0, round(avg(v), 8) AS revenue_1 FROM p GROUP BY ALL)
SELECT n_nationkey AS subject, n_name, r_name, revenue_0, revenue_1 FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN a ON subject = n_nationkey""")
def view_team_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (ViewColumn("revenue", Output("count", "season", (">", 500000))), ViewColumn("revenue", Output("mean", "season")))
    return plan_view(star_catalog(spark, sf_dir), ViewRequest(columns, grain="team", limit=None))


@query("""SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(round(CAST(p_retailprice / (p_size * p_size) * 703 AS DECIMAL(30,6)), 2) AS DOUBLE) END AS mass, CASE WHEN p_size > 0 THEN CAST(round(CAST(p_retailprice * 200 / pow(p_size, 4) AS DECIMAL(30,6)), 2) AS DOUBLE) END AS speed, CAST(coalesce(p_size, 0) + coalesce(CASE WHEN p_size > 20 THEN p_size END, 0) AS INTEGER) AS agility,
upper(concat_ws(' ', split_part(p_name, ' ', 1), p_type)) AS full_name FROM part""")
def attribute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalar.body_mass_index(price, size).alias("mass"), scalar.plain_speed_score(price, size).alias("speed"), scalar.sum_of_known(size, F.when(size > 20, size)).alias("agility"),
        F.upper(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type")).alias("full_name"),
    )


@query("""WITH a AS (SELECT o_orderkey, age(DATE '2002-03-01', CAST(o_orderdate AS DATE)) AS a FROM orders) SELECT o_orderkey, round(date_part('year', a) + date_part('month', a) / 12.0 + date_part('day', a) / 365.25, 2) AS age FROM a JOIN orders USING (o_orderkey)""")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.age_years(F.lit("2002-03-01").cast("date"), F.col("o_orderdate")).alias("age"))


@query("""SELECT p_partkey, p_name FROM part WHERE list_has_all(string_split(lower(p_name), ' '), ['large', 'bolt'])""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(scalar.name_matches(F.col("p_name"), "Bolt large")).select("p_partkey", "p_name")


@query("""SELECT l_suppkey, count(*) AS n FROM lineitem WHERE (l_returnflag = 'R' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linenumber = 1) GROUP BY ALL""")
def preset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = Presets(({"l_returnflag": "R", "l_linestatus": "F"}, {"l_returnflag": "N", "l_linenumber": 1}))
    return table(spark, sf_dir, "lineitem").filter(presets.apply()).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS s FROM orders GROUP BY ALL) SELECT o_custkey, array_to_string(list_sort(s), ',') AS statuses FROM a WHERE list_has_any(s, ['P', 'X'])""")
def array_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return sets.filter(Filter("s", "OVERLAPS", ("P", "X")).apply()).select("o_custkey", F.array_join("s", ",").alias("statuses"))


@query("""WITH t AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year, s_nationkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT o_custkey, year, string_agg(n_name, ',' ORDER BY n_name) AS teams, count(*) AS n FROM t JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def team_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    played = order_lines(spark, sf_dir).join(teams, F.col("l_suppkey") == F.col("s_suppkey"))
    return played.groupBy("o_custkey", "year").agg(F.array_sort(F.collect_set("n_name")).alias("t")).select("o_custkey", "year", F.array_join("t", ",").alias("teams"), F.size("t").cast("long").alias("n"))


@query("""WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), a AS (SELECT o_custkey, count(*) AS open FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, a.open, b.o_custkey IS NOT NULL AS has_pending FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def full_outer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    pending = orders.filter("o_orderstatus = 'P'").select("custkey").distinct().withColumn("p", F.lit(True))
    made = orders.filter("o_orderstatus = 'O'").groupBy("custkey").agg(F.count("*").alias("open"))
    return made.join(pending, "custkey", "full").select("custkey", "open", F.coalesce("p", F.lit(False)).alias("has_pending"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def exists_and_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer")
    return customers.join(orders.filter("o_totalprice > 300000"), "c_custkey", "left_semi").join(orders.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH $LINES, m AS (SELECT DISTINCT o_orderkey, c_nationkey AS home, s_nationkey AS away FROM lines JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
u AS (SELECT o_orderkey, home AS team, away AS opponent FROM m UNION SELECT o_orderkey, away, home FROM m) SELECT team, opponent, count(*) AS games FROM u GROUP BY ALL""")
def opponents_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes, aways = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    games = table(spark, sf_dir, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = by_order(spark, sf_dir, table(spark, sf_dir, "lineitem").join(aways, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey"), games)
    sides = F.array(F.struct(F.col("c_nationkey").alias("team"), F.col("s_nationkey").alias("opponent")), F.struct(F.col("s_nationkey").alias("team"), F.col("c_nationkey").alias("opponent")))
    met = lines.filter("c_nationkey <> s_nationkey").select("o_orderkey", F.explode(sides).alias("s")).select("o_orderkey", "s.*").distinct()
    return met.groupBy("team", "opponent").agg(F.count("*").alias("games"))


@query("""WITH v AS (SELECT event_type, CAST(props ->> '$.k' AS INTEGER) AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM v GROUP BY ALL""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("""WITH m AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linenumber = 1) AS spread, sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linenumber = 2) AS total FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST((total - spread) / 2 AS DOUBLE) AS implied FROM m WHERE spread IS NOT NULL AND total IS NOT NULL""")
def implied_team_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    # Two slices of one table by one key: conditional sums read it once where a self-join reads it twice.
    slices = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_linenumber") == k, price)).alias(n) for k, n in ((1, "spread"), (2, "total"))])
    return slices.filter("spread is not null and total is not null").select("l_orderkey", ((F.col("total") - F.col("spread")).cast("double") / 2).alias("implied"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS price, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), NULL) AS until FROM orders)
SELECT o_custkey, o_orderkey AS held, CAST(price AS DOUBLE) AS price FROM a WHERE until IS NULL""")
def open_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = joins.latest_per_key(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return last.select("o_custkey", F.col("o_orderkey").alias("held"), F.col("o_totalprice").alias("price"))


@query("""WITH e AS (SELECT o_orderkey AS source, o_custkey, o_orderdate, lead(o_orderkey) OVER w AS target, lead(o_orderdate) OVER w AS moved FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT source, target, date_diff('day', e.o_orderdate, moved) AS days, s.o_orderstatus AS given, t.o_orderstatus AS taken FROM e JOIN orders s ON source = s.o_orderkey JOIN orders t ON target = t.o_orderkey""")
def asset_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    after = lambda c: F.lead(c).over(order)
    flow = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), after("o_orderkey").alias("target"), F.date_diff(after("o_orderdate"), "o_orderdate").cast("long").alias("days"), F.col("o_orderstatus").alias("given"), after("o_orderstatus").alias("taken"))
    return flow.filter("target is not null")


@query("""SELECT l_suppkey, round(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*), 4) AS per_play, round(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0), 4) AS per_open,
round(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / nullif(count(*) FILTER (WHERE l_quantity BETWEEN 20 AND 99), 0), 4) AS per_deep FROM lineitem GROUP BY ALL""")
def filtered_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    top = count(F.col("l_returnflag") == "R")
    rate = lambda bottom: F.round(F.try_divide(top, F.nullif(bottom, F.lit(0))), 4)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        rate(F.count("*")).alias("per_play"), rate(count(F.col("l_linestatus") == "O")).alias("per_open"), rate(count(F.col("l_quantity").between(20, 99))).alias("per_deep")
    )

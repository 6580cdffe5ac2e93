"""Registered queries on agreeing signals and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import fits, signals
from tidemark.registry import query
from tidemark.sources.star import order_lines, table

#: First years after an era, with the least counts of its grades.
ERAS = [(1993, {}), (1996, {"medium": 1}), (None, {"medium": 1, "high": 2})]
RIDGE, NEWTON_STEPS = 1.0, 8


@query("""WITH o AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), s AS (SELECT DISTINCT o_custkey, year FROM o),
r AS (SELECT DISTINCT o_custkey, year FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
f AS (SELECT s.o_custkey, s.year, r.year IS NOT NULL AS returned,
  EXISTS (SELECT 1 FROM o WHERE o.o_custkey = s.o_custkey AND o.year = s.year AND o_orderpriority = '1-URGENT') AS urgent,
  EXISTS (SELECT 1 FROM o WHERE o.o_custkey = s.o_custkey AND o.year = s.year AND o_totalprice >= 150000) AS costly
  FROM s LEFT JOIN r ON r.o_custkey = s.o_custkey AND r.year = s.year),
c AS (SELECT *, CAST(returned AS INTEGER) + CAST(urgent AS INTEGER) + CAST(costly AS INTEGER) AS source_concurrence FROM f)
SELECT *, CASE WHEN returned THEN 'returned' WHEN costly THEN 'costly' WHEN urgent THEN 'urgent' END AS reason,
  CASE WHEN year < 1993 THEN 'low' WHEN source_concurrence = 0 THEN 'low' WHEN year < 1996 OR source_concurrence < 2 THEN 'medium' ELSE 'high' END AS confidence FROM c""")
def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_custkey", "year"]
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    found = {
        "returned": order_lines(spark, sf_dir).filter("l_returnflag = 'R'"),
        "urgent": orders.filter("o_orderpriority = '1-URGENT'"),
        "costly": orders.filter("o_totalprice >= 150000"),
    }
    met = signals.concurrence(orders.select(*keys).distinct(), keys, found)
    reason = signals.first_reason({name: F.col(name) for name in ("returned", "costly", "urgent")})
    return met.withColumns({"reason": reason, "confidence": signals.confidence(F.col("year"), F.col("source_concurrence"), ERAS)})


def _newton_sql() -> str:
    """As many steps as converge; each is one statement on the one before."""
    steps = [
        f"""s{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS g0, sum((y - p) * z) - {RIDGE} * any_value(b) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * z) AS h1, sum(p * (1 - p) * z * z) + {RIDGE} AS h2
  FROM (SELECT a, b, z, y, 1 / (1 + exp(-(a + b * z))) AS p FROM d, b{i})),
b{i + 1} AS (SELECT a + (g0 * h2 - g1 * h1) / (h0 * h2 - h1 * h1) AS a, b + (g1 * h0 - g0 * h1) / (h0 * h2 - h1 * h1) AS b FROM s{i})"""
        for i in range(NEWTON_STEPS)
    ]
    return f"""WITH r AS (SELECT o_orderkey, o_totalprice AS x, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM orders),
m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM r), d AS (SELECT o_orderkey, (x - mu) / sd AS z, y FROM r, m), b0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b),
{", ".join(steps)}
SELECT o_orderkey, y AS label, round(1 / (1 + exp(-(a + b * z))), 6) AS probability FROM d, b{NEWTON_STEPS}"""


@query(_newton_sql())
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("label", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double"))
    model = fits.logistic(orders, "label", ["o_totalprice"], RIDGE)
    return orders.select("o_orderkey", "label", F.round(model.probability(), 6).alias("probability"))

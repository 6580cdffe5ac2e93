"""Where queries and the SQL that gives the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Lines with their order's calendar, as every statement reads them.
LINES = """lines AS (
  SELECT l.*, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS disc, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         o_orderkey, o_custkey, o_orderdate, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS week, c_nationkey
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("$LINES", LINES)
        return f

    return add

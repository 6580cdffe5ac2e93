"""Registered queries on aggregates that are kept up to date after edits of single partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.maintained import Maintained
from tidemark.registry import query
from tidemark.sources.star import order_lines
from tidemark.storage import Workspace, delete

EDITED = """before AS (SELECT l_suppkey, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue, CAST(sum(qty) AS DOUBLE) AS pieces FROM lines WHERE l_suppkey % 7 <> 0 OR year = 1992 GROUP BY ALL),
after AS (SELECT l_suppkey, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue, CAST(sum(qty) AS DOUBLE) AS pieces FROM lines WHERE (l_suppkey % 7 <> 0 AND year <> 1992 AND (year <> 1995 OR qty < 40)) OR (l_suppkey % 7 = 0 AND year = 1995 AND l_suppkey % 2 = 0) GROUP BY ALL)"""


def edited_totals(spark: SparkSession, sf_dir: str) -> Maintained:
    """Totals by supplier over lines by year. First without every seventh supplier but in 1992; then
    1992 goes, and 1995 loses its large lines and gains half of those suppliers."""
    space = Workspace(spark, "maintained")
    source = space.path("lines")
    seventh = F.col("l_suppkey") % 7 == 0
    lines = order_lines(spark, sf_dir).select("year", "l_suppkey", "l_extendedprice", "l_quantity")
    lines.filter(~seventh | (F.col("year") == 1992)).write.partitionBy("year").parquet(source)
    kept = Maintained(spark, space.path("totals"), source, "year", ["l_suppkey"], {"revenue": "l_extendedprice", "pieces": "l_quantity"})
    kept.refresh()
    delete(spark, f"{source}/year=1992")
    edited = lines.filter((F.col("year") == 1995) & ((~seventh & (F.col("l_quantity") < 40)) | (seventh & (F.col("l_suppkey") % 2 == 0))))
    edited.drop("year").write.mode("overwrite").parquet(f"{source}/year=1995")
    kept.refresh()
    return kept


@query(f"WITH $LINES, {EDITED} SELECT * FROM after")
def maintained_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = edited_totals(spark, sf_dir).state()
    return state.withColumns({c: F.col(c).cast("double") for c in ("revenue", "pieces")})


@query(f"""WITH $LINES, {EDITED} SELECT l_suppkey, CASE WHEN b.n IS NULL THEN 'insert' WHEN a.n IS NULL THEN 'delete' ELSE 'update' END AS change, b.n AS old_n, b.revenue AS old_revenue, b.pieces AS old_pieces, a.n AS new_n, a.revenue AS new_revenue, a.pieces AS new_pieces
FROM before b FULL JOIN after a USING (l_suppkey) WHERE b.n IS DISTINCT FROM a.n OR b.revenue IS DISTINCT FROM a.revenue OR b.pieces IS DISTINCT FROM a.pieces""")
def maintained_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = edited_totals(spark, sf_dir).changelog(1)
    return changes.withColumns({f"{s}_{c}": F.col(f"{s}_{c}").cast("double") for s in ("old", "new") for c in ("revenue", "pieces")})

"""Registered queries on live projections from streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.registry import query
from tidemark.streaming import live, windows


def live_rows(events: DataFrame, kinds: tuple[str, ...], kind: Column) -> DataFrame:
    """Purchases are plays, errors correct them, and views say what is projected."""
    return events.filter(F.col("event_type").isin(*kinds)).select(F.col("user_id").alias("subject"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"))


@query("""WITH e AS (SELECT user_id AS subject, ts, event_id, CAST(ts AS DATE) AS day, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE event_type IN ('purchase', 'error', 'view')),
w AS (SELECT least(max(ts) FILTER (WHERE event_type <> 'view'), max(ts) FILTER (WHERE event_type = 'view')) - INTERVAL 10 MINUTE AS mark FROM e),
g AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY subject, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e WHERE event_type <> 'view'),
p AS (SELECT subject, day, arg_max(v, (ts, event_id)) AS points FROM g WHERE k > 0 GROUP BY subject, day, k), t AS (SELECT subject, day, count(*) AS plays, CAST(sum(points) AS BIGINT) AS points FROM p GROUP BY ALL),
l AS (SELECT subject, day, max(ts) AS last FROM e WHERE event_type = 'purchase' GROUP BY ALL),
q AS (SELECT l.subject, l.day, arg_max(v, (ts, event_id)) AS quote FROM l JOIN e ON e.subject = l.subject AND e.day = l.day AND event_type = 'view' AND ts BETWEEN last - INTERVAL 3 HOUR AND last GROUP BY ALL),
r AS (SELECT d.subject, d.day, coalesce(plays, 0) AS plays, coalesce(points, 0) / 100.0::DOUBLE AS accumulated, quote / 100.0::DOUBLE AS projection, coalesce(CAST(epoch_us(last) - epoch_us(CAST(d.day AS TIMESTAMP)) AS DOUBLE) / 86400000000, 0) AS progress
  FROM (SELECT DISTINCT subject, day FROM e, w WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= mark) d LEFT JOIN t USING (subject, day) LEFT JOIN l USING (subject, day) LEFT JOIN q USING (subject, day))
SELECT subject, CAST(day AS VARCHAR) AS day, plays, accumulated, projection, round(progress, 6) AS progress, round(coalesce(projection, 0) * (1 - progress), 4) AS remaining, round(accumulated + coalesce(projection, 0) * (1 - progress), 4) AS total FROM r""")
def stream_live_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = windows.table_stream(spark, sf_dir)
    plays = live_rows(events, ("purchase", "error"), F.when(F.col("event_type") == "error", live.CORRECTION).otherwise(live.PLAY))
    with live.keyed_state(spark):
        games = windows.drain(live.live_projections(plays, live_rows(events, ("view",), F.lit(live.PROJECTION))), "append")
    return games.withColumn("day", F.col("day").cast("string"))

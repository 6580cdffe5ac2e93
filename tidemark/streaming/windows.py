"""Event-time windows on a stream of the events table, and their batch twins.

A drained stream must hold what the batch query gives, which is how these are tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.storage import Workspace

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the directory listing is narrowed to one table."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_counts(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "10 minutes") -> DataFrame:
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def open_close(events: DataFrame, key: str) -> DataFrame:
    """First and last value of each key so far; a late event changes them like any other, so a row of
    state is kept for each key as long as the stream runs. Where keys end, use ``live``'s timers."""
    at = F.struct("ts", "event_id", "value")
    first = events.groupBy(key).agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("n"))
    return first.select(key, F.col("a.value").alias("open_value"), F.col("z.value").alias("close_value"), F.col("a.ts").cast("timestamp_ntz").alias("opened"), F.col("z.ts").cast("timestamp_ntz").alias("closed"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row for each key; state is kept as long as the watermark allows a copy to come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_latest(stream: DataFrame, path: str, keys: list[str], partition: str, order: str, checkpoint: str):
    """Starts a query that keeps the latest row of each key in a partitioned Parquet table. A batch
    that is run again after a failure leaves the same table."""
    from tidemark.sources.files import upsert

    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch, path, keys, partition, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


def drain(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what its source holds now and returns its result table, which is kept as
    Parquet in the shared folder beside the stream's checkpoint. In complete mode each batch replaces
    the table, so that a batch that is run again leaves the same one."""
    space = Workspace(result.sparkSession, "drained")
    path = space.path("rows")
    result.sparkSession.createDataFrame([], result.schema).write.parquet(path)  # a source without files runs no batch
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)

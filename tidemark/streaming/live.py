"""Live projections: plays, corrections and projections of a game met by event time in keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LIVE = "subject long, plays long, accumulated double, projection double, progress double, remaining double, total double, day date"
#: Kinds of rows. A correction replaces the points of the latest play at or before it.
PLAY, CORRECTION, PROJECTION = "play", "correction", "projection"


@contextmanager
def keyed_state(spark: SparkSession):
    """A state store that is not bounded by memory, for streams that start in here."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def projected(rows: list[tuple], day: int, within: int) -> tuple:
    """What a game's rows (at, id, kind, value) come to at its end: plays, points with corrections, the
    projection last seen ``within`` before the last play, progress at that play, what the projection
    leaves from there on, and the total. Times are microseconds and values cents; results are units."""
    points: list[int] = []
    last, quote = None, None
    rows = sorted(rows)
    for at, _, kind, value in rows:
        if kind == PLAY:
            points.append(value)
            last = at
        elif kind == CORRECTION and points:
            points[-1] = value
    if last is None:
        return 0, 0.0, None, 0.0, 0.0, 0.0
    for at, _, kind, value in rows:
        if kind == PROJECTION and last - within <= at <= last:
            quote = value
    progress = min(1.0, max(0.0, (last - day) / DAY))
    remaining = (quote or 0) / 100 * (1 - progress)
    total = sum(points) / 100
    return len(points), total, None if quote is None else quote / 100, round(progress, 6), round(remaining, 4), round(total + remaining, 4)


def ended_games(within: int):
    """Batches of ended games (subject, day_number, rows) as their lines."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subjects, days, games = (batch.column(n) for n in ("subject", "day_number", "rows"))
            cells = games.flatten()
            arrived, at, own, kind, value = (cells.field(n).to_pylist() for n in ("arrived", "us", "id", "kind", "value"))
            ends, start, out = games.value_lengths().to_pylist(), 0, []
            for day, size in zip(days.to_pylist(), ends):
                span = range(start, start + size)
                latest: dict[int, tuple] = {}
                for i in span:
                    row = (arrived[i], at[i], kind[i], value[i])
                    if own[i] not in latest or row > latest[own[i]]:
                        latest[own[i]] = row
                out.append(projected([(t, k, what, worth) for k, (_, t, what, worth) in latest.items()], day * DAY, within))
                start += size
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64()] + [pa.float64()] * 5
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([subjects, *made, days.cast(pa.int32()).cast(pa.date32())], ["subject", "plays", "accumulated", "projection", "progress", "remaining", "total", "day"])

    return lines


def live_projections(plays: DataFrame, projections: DataFrame, late: str = "10 minutes", within: int = 3 * HOUR) -> DataFrame:
    """Streams of plays and corrections (subject, at, id, kind, value in cents) and of projections (the
    same columns) as one row for each subject and day (UTC), once the watermark of both has passed the
    day's end. An id that comes twice counts as it came last, by batches (within one, the later and then
    the larger row); a day without plays has a row of zeros. Rows of a day that has ended are late and
    do not count; until then every row does. Start the stream within ``keyed_state``.

    State is one group of a windowed aggregation for each subject and day, which holds the game's rows
    and goes when the day has ended, and only ended games reach Python, many in a batch.
    """
    columns = ["subject", "at", "id", "kind", "value"]
    both = plays.withWatermark("at", late).select(*columns).unionByName(projections.withWatermark("at", late).select(*columns))
    # Days of the window are cut from the epoch on, so they are days of UTC in any session's zone.
    row = F.struct(F.unix_micros(F.current_timestamp()).alias("arrived"), F.unix_micros("at").alias("us"), "id", "kind", "value")
    timed = both.filter("subject is not null and at is not null").withColumn("row", row)
    games = timed.groupBy(F.window("at", "1 day"), "subject").agg(F.collect_list("row").alias("rows"))
    number = F.floor(F.unix_micros("window.start") / DAY).cast("long").alias("day_number")
    return games.select("subject", number, "rows").mapInArrow(ended_games(within), LIVE)

"""Live projections over several batches: late corrections count, rows behind the watermark do not."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import live, windows

SHAPE = "subject long, at timestamp, id long, kind string, value long"
T = lambda day, hour, minute=0: dt.datetime(2024, 3, day, hour, minute, tzinfo=dt.timezone.utc)


def test_what_a_game_comes_to():
    rows = [(2 * live.HOUR, 1, "play", 500), (3 * live.HOUR, 2, "correction", 300), (1 * live.HOUR, 3, "correction", 900), (6 * live.HOUR, 4, "play", 200), (4 * live.HOUR, 5, "projection", 4000), (1 * live.HOUR, 6, "projection", 9000), (7 * live.HOUR, 7, "projection", 8000)]
    assert live.projected(rows, 0, 3 * live.HOUR) == (2, 5.0, 40.0, 0.25, 30.0, 35.0)
    assert live.projected([r for r in rows if r[2] != "play"], 0, live.HOUR) == (0, 0.0, None, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("per_batch", [1, 10])
def test_corrections_that_come_late(spark, tmp_path, per_batch):
    batches = [
        [(1, T(1, 10), 1, "play", 500), (1, T(1, 9), 2, "projection", 1000), (2, T(1, 12), 3, "play", 100), (None, T(1, 1), 90, "play", 1), (3, T(1, 5), 91, "projection", 100)],
        [(1, T(1, 10, 30), 4, "correction", 200), (1, T(1, 10), 1, "play", 500), (1, T(1, 8), 5, "correction", 999), (2, T(1, 23, 50), 6, "play", 50)],
        [(1, T(3, 1), 7, "play", 1), (1, T(3, 1), 8, "projection", 1)],
        [(1, T(5, 1), 10, "play", 1), (1, T(5, 1), 11, "projection", 1)],
        [(1, T(1, 11), 9, "correction", 1)],
    ]
    for i, rows in enumerate(batches):
        folder = tmp_path / f"part{i}"
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(folder))
        (file,) = folder.glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(file, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", per_batch).parquet(f"file://{tmp_path}/in")
    quote = F.col("kind") == live.PROJECTION
    with live.keyed_state(spark):
        found = windows.drain(live.live_projections(stream.filter(~quote), stream.filter(quote)), "append")
    rows = found.collect()
    got = {(r["subject"], str(r["day"])): (r["plays"], r["accumulated"], r["projection"], r["total"]) for r in rows}
    # In one batch nothing is late, so the last correction counts as well.
    first = (1, 2.0, 10.0, 7.8333) if per_batch == 1 else (1, 0.01, 10.0, 5.8433)
    assert len(rows) == len(got) and got == {(1, "2024-03-01"): first, (2, "2024-03-01"): (2, 1.5, None, 1.5), (3, "2024-03-01"): (0, 0.0, None, 0.0), (1, "2024-03-03"): (1, 0.01, 0.01, 0.0196)}
    assert spark.conf.get(live.PROVIDER, None) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_games_need_no_call_to_python_for_each_row(spark):
    """State is kept by Spark's own aggregation; a day's rows reach Python once, in batches of games."""
    import contextlib
    import io

    stream = spark.readStream.schema(SHAPE).parquet("file:///root/testdata/sf0.001/none*")
    quote = F.col("kind") == live.PROJECTION
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        live.live_projections(stream.filter(~quote), stream.filter(quote)).explain()
    assert "TransformWithState" not in shown.getvalue() and "StateStoreSave" in shown.getvalue()


def test_an_id_that_comes_twice_counts_as_it_came_last():
    import pyarrow as pa

    row = lambda arrived, at, own, value: {"arrived": arrived, "us": at * live.HOUR, "id": own, "kind": "play", "value": value}
    games = [[row(2, 1, 1, 100), row(1, 3, 1, 900), row(1, 2, 2, 50)], [], [row(1, 30, 3, 7)]]
    shape = pa.list_(pa.struct([("arrived", pa.int64()), ("us", pa.int64()), ("id", pa.int64()), ("kind", pa.string()), ("value", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, None], pa.int64()), pa.array([0, 0, 1], pa.int64()), pa.array(games, shape)], ["subject", "day_number", "rows"])
    (out,) = live.ended_games(live.HOUR)(iter([batch.slice(0)]))
    assert [(r["subject"], str(r["day"]), r["plays"], r["accumulated"]) for r in out.to_pylist()] == [(5, "1970-01-01", 2, 1.5), (6, "1970-01-01", 0, 0.0), (None, "1970-01-02", 1, 0.07)]
    (cut,) = live.ended_games(live.HOUR)(iter([batch.slice(2)]))
    assert [(r["plays"], r["accumulated"]) for r in cut.to_pylist()] == [(1, 0.07)]

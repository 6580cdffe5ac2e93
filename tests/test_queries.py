"""Every core query against DuckDB on the smallest tables, and the declarations' own rules."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans.model import Filter, Output
from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return "NULL"
        if isinstance(v, (str, bool, pd.Timestamp)):
            return str(v)
        return f"{float(v):.6f}"

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_output_rules():
    with pytest.raises(ValueError):
        Output("count", "game")
    with pytest.raises(ValueError):
        Output("mean", "game", (">=", 1))
    with pytest.raises(ValueError):
        Output("rate")


def test_empty_filters_are_none(spark):
    assert all(Filter("a", "IN", v).apply() is None for v in ((), [], "", None))
    assert Filter("a", "=", 0).apply() is not None


def test_asof_without_match_and_with_ties(spark):
    from tidemark.operators.joins import asof_join

    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0), (1, 5, 30.0)], "k int, s int, v double")
    got = {(r["k"], r["t"]): (r["asof_s"], r["asof_v"]) for r in asof_join(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {(1, 5): (5, 30.0), (1, 1): (None, None), (2, 9): (None, None)}


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    from tidemark.sources import files

    path, schema = str(tmp_path / "t"), "k int, v string, y int"
    files.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], schema), path, ["k"], "y")
    files.upsert(spark.createDataFrame([(1, "z", 1), (4, "d", 1)], schema), path, ["k"], "y")
    files.upsert(spark.createDataFrame([(3, "no", 2)], schema), path, ["k"], "y", keep_old=True)
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {1: "z", 2: "b", 3: "c", 4: "d"}
    files.replace_scope(spark.createDataFrame([(1, "q", 1)], schema), path, "y")
    assert {r["k"]: r["v"] for r in spark.read.schema(schema).parquet(path).collect()} == {1: "q", 3: "c"}


def test_stream_upsert_keeps_the_latest(spark, tmp_path):
    from tidemark.streaming import windows

    stream = windows.table_stream(spark, SF).withColumn("bucket", F.col("user_id") % 3)
    path = str(tmp_path / "latest")
    windows.upsert_latest(stream, path, ["user_id"], "bucket", "ts", str(tmp_path / "cp")).awaitTermination()
    found = {r["user_id"]: r["ts"] for r in spark.read.parquet(path).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    assert found == {r["user_id"]: r["ts"] for r in events.collect()}


def test_exports(spark, tmp_path):
    from tidemark.sources import files

    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    lines = lambda kind: [r["value"] for r in files.rendered(df, kind).orderBy("part", "at").collect()]
    assert lines("md") == ["| k | v |", "| - | - |", "| 1 | a b |", "| 2 |  |"]
    assert lines("html")[2:] == ["<tr><td>1</td><td>a|b</td></tr>", "<tr><td>2</td><td></td></tr>", "</table>"]
    files.export(df, str(tmp_path / "c"), "csv")
    assert files.read_csv(spark, str(tmp_path / "c"), "k int, v string").count() == 2
    with pytest.raises(ValueError):
        files.rendered(df, "pdf")


def test_dynamic_values():
    from tidemark.plans.dynamic import Clock, resolve

    clock = Clock(2024, 3)
    assert resolve(clock, "last_n_years", 3) == (2022, 2023, 2024)
    assert resolve(clock, "last_n_weeks", 5) == (1, 2, 3)
    assert resolve(Clock(2024, 17), "next_n_weeks", 5) == (17, 18)
    with pytest.raises(ValueError):
        resolve(clock, "last_n_days")


def test_scalar_helpers(spark):
    from tidemark.functions import scalar

    row = spark.range(1).select(
        scalar.game_progress(F.lit(2), F.lit("07:30"), F.lit(False)).alias("progress"),
        scalar.game_progress(F.lit(5), F.lit(None).cast("string"), F.lit(False)).alias("overtime"),
        scalar.live_projection(F.lit(10.0), F.lit(20.0), F.lit(0.25)).alias("live"),
        scalar.personnel_counts(F.lit("1 RB, 2 TE, 2 WR")).alias("personnel"),
        scalar.similar_names(F.lit("Jon Smith"), F.lit("John Smith")).alias("near"),
        scalar.similar_names(F.lit("Ann Lee"), F.lit("Bob Kay")).alias("far"),
        scalar.month_day(F.lit(2023), 2, 30).cast("string").alias("day"),
    ).first()
    assert row["progress"] == 0.375 and row["overtime"] == 1.0 and row["live"] == 25.0
    assert row["personnel"] == {"RB": 1, "TE": 2, "WR": 2}
    assert row["near"] and not row["far"] and row["day"] == "2023-02-28"


def test_walk_reaches_depth_20_and_holds_the_roots(spark):
    from tidemark.operators.joins import walk

    nodes = spark.createDataFrame([(i,) for i in range(25)], "node long")
    edges = spark.createDataFrame([(i, i + 1 if i < 23 else None, 0.5) for i in range(24)], "source long, target long, share double")
    got = sorted((r["root"], r["node"], r["depth"], r["weight"]) for r in walk(nodes, edges).collect())
    assert got == [(a, b, b - a, 0.5 ** (b - a)) for a in range(24) for b in range(a, min(a + 21, 24))] + [(24, 24, 0, 1.0)]


@pytest.mark.parametrize("name", ["stream_deduplicated", "stream_open_close", "stream_tumbling", "stream_sliding", "stream_static_join"])
def test_drained_streams_are_files_in_the_shared_folder(spark, name):
    from tidemark.storage import shared_root

    files = QUERIES[name](spark, SF).inputFiles()
    assert files and all(f"{shared_root(spark).removeprefix('file://')}/drained-" in f for f in files)


def test_attach_refuses_what_it_has_no_rule_for(spark):
    from tidemark.plans.attach import Attached, Source
    from tidemark.plans.model import ViewRequest
    from tidemark.plans.view import plan_view
    from tidemark.queries_attach import sourced_catalog

    catalog = sourced_catalog(spark, SF)
    with pytest.raises(ValueError, match="cannot be attached"):
        plan_view(catalog, ViewRequest((), grain="team", attached=(Attached("a", "account", "c_acctbal"),)))
    with pytest.raises(ValueError, match="for one year"):
        plan_view(catalog, ViewRequest((), attached=(Attached("a", "order_year", "placed"),)))
    with pytest.raises(ValueError, match="unknown sources"):
        plan_view(catalog, ViewRequest((), attached=(Attached("a", "nothing", "x"),)))
    with pytest.raises(ValueError, match="names no column"):
        Source("s", spark.range(1), "team_year", {"team": "id"})


def test_requests_are_checked_before_planning(spark):
    from tidemark.plans.model import ViewColumn, ViewRequest
    from tidemark.plans.view import plan_view
    from tidemark.sources.star import star_catalog

    catalog = star_catalog(spark, SF)
    revenue = (ViewColumn("revenue"),)
    wrong = (
        ViewRequest(revenue, grain="club"), ViewRequest(revenue, axes=("week",)), ViewRequest(revenue, axes=("year",)), ViewRequest((ViewColumn("x"),)),
        ViewRequest((ViewColumn("revenue", Output("rate", "x")),)), ViewRequest(revenue, sort=(("x", True),)), ViewRequest(revenue, computed=(("revenue_0", "1"),)),
    )
    for request in wrong:
        with pytest.raises(ValueError):
            plan_view(catalog, request)

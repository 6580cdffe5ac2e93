"""Scans, ranks and quantiles over ranges, and the lineage of assets, against plain Python."""

import datetime as dt
import math
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, lineage, ordered

KEEP_RUNS = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.fixture(autouse=True)
def many_runs(spark):
    """Small inputs stay in as many ranges as there are shuffle partitions."""
    spark.conf.set(KEEP_RUNS, "false")
    yield
    spark.conf.unset(KEEP_RUNS)


def crowd() -> list[tuple]:
    """Rows of which half have one key; nulls in keys, orders and values."""
    rng = np.random.default_rng(2)
    keys = ["hot"] * 300 + [None] * 40 + [f"k{i % 60}" for i in range(260)]
    return [(k, i if rng.random() < 0.98 else None, int(rng.integers(0, 30)) if rng.random() < 0.8 else None, i) for i, k in enumerate(keys)]


SHAPE = "k string, at int, v int, i int"


@pytest.mark.parametrize("before", [False, True])
def test_scan_carries_values_from_range_to_range(spark, before):
    rows = crowd()
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    got = {r["i"]: (r["total"], r["latest"]) for r in ordered.scan(df, ["k"], ["at", "i"], {"total": F.col("v")}, {"latest": F.when(F.col("v") > 9, F.col("v"))}, before).collect()}
    own = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        own[row[0]].append(row)
    for mine in own.values():
        for n, row in enumerate(mine):
            seen = [r[2] for r in mine[: n + (not before)] if r[2] is not None]
            assert got[row[3]] == (sum(seen) if seen else None, next((v for v in reversed(seen) if v > 9), None))
    assert df.repartitionByRange("k", "at", "i").filter("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    assert ordered.scan(df.limit(0), ["k"], ["at"], {"total": F.col("v")}).count() == 0


def test_ranks_and_quantiles(spark):
    rows = crowd()
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    ranks = {r["i"]: r["place"] for r in ordered.competition_ranks(df, ["k"], "v", "place").collect()}
    own = defaultdict(list)
    for k, _, v, _ in rows:
        if v is not None:
            own[k].append(v)
    assert ranks == {i: None if v is None else 1 + sum(x > v for x in own[k]) for k, _, v, i in rows}
    points = {"p10": (0.1, "disc"), "p95": (0.95, "disc"), "low": (0.0, "disc"), "high": (1.0, "disc"), "middle": (0.5, "cont"), "upper": (0.8, "cont")}
    found = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", points).collect()}
    assert set(found) == set(own)
    for k, values in own.items():
        values = sorted(values)
        at = lambda part: values[max(1, math.ceil(round(part * len(values), 9))) - 1]
        r = found[k]
        assert (r["p10"], r["p95"], r["low"], r["high"]) == (at(0.1), at(0.95), values[0], values[-1])
        assert r["middle"] == pytest.approx(np.quantile(values, 0.5)) and r["upper"] == pytest.approx(np.quantile(values, 0.8))


def test_asof_of_a_crowded_key(spark):
    rng = np.random.default_rng(4)
    left = [("hot" if i % 2 else f"k{i}", int(t), i) for i, t in enumerate(rng.integers(0, 500, 200))]
    right = [("hot", int(t), int(v)) for t, v in zip(rng.integers(0, 500, 150), rng.integers(0, 9, 150))]
    a, b = spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, seen int, v int")
    got = {r["i"]: (r["asof_seen"], r["asof_v"]) for r in joins.asof_join(a, b, ["k"], "at", "seen", ["v"]).collect()}
    for k, at, i in left:
        assert got[i] == max(((t, v) for own, t, v in right if own == k and t <= at), default=(None, None))


EVENT = "asset string, n int, at date, kind string, team int, giver int, trade long, salary decimal(18,2), value decimal(18,2)"


def test_holdings_and_what_they_became(spark):
    """A trade of two assets for one, an extension, a poach, and releases that count and that do not."""
    day = lambda n: dt.date(2020, 1, n)
    events = [
        ("a", 1, day(1), "acquire", 1, None, None, 5, 10), ("a", 2, day(3), "release", 2, None, None, None, None), ("a", 3, day(5), "move", 2, 1, 7, None, 30),
        ("b", 1, day(2), "endow", 1, None, None, None, 1), ("b", 2, day(5), "move", 2, 1, 7, None, 10),
        ("c", 1, day(1), "acquire", 2, None, None, 8, 1), ("c", 2, day(4), "acquire", 2, None, None, 9, 1), ("c", 3, day(5), "move", 1, 2, 7, None, 40), ("c", 4, day(9), "release", 1, None, None, None, None), ("c", 5, day(10), "release", 1, None, None, None, None),
        ("a", 4, day(8), "acquire", 3, None, None, 2, 1), ("d", 1, day(1), "release", 1, None, None, None, None), ("c", 6, day(12), "move", 3, 1, 8, None, 5),
    ]
    held = lineage.holdings(spark.createDataFrame([(*e[:7], *(None if x is None else Decimal(x) for x in e[7:])) for e in events], EVENT), ["n"])
    rows = {f"{r['asset']}:{r['number']}": (r["team"], r["terminated_by"], r["period_end"], r["previous"], None if r["salary_paid"] is None else int(r["salary_paid"])) for r in held.collect()}
    assert rows == {
        "a:1": (1, "trade", day(5), None, 5), "a:2": (2, "trade", day(8), 1, 5), "a:3": (3, "still_held", None, 2, 2), "b:1": (1, "trade", day(5), None, None), "b:2": (2, "still_held", None, 1, None),
        "c:1": (2, "extension", day(4), None, 8), "c:2": (2, "trade", day(5), 1, 9), "c:3": (1, "release", day(9), 2, 9), "c:4": (3, "still_held", None, None, None),
    }
    became = {(r["source"], r["target"]): (r["team"], r["source_share"], r["target_share"]) for r in lineage.considerations(held).collect()}
    assert became == {("a:1", "c:3"): (1, 0.75, 1.0), ("b:1", "c:3"): (1, 0.25, 1.0), ("c:2", "a:2"): (2, 1.0, 0.75), ("c:2", "b:2"): (2, 1.0, 0.25)}
    kinds = {(r["source"], r["target"]): r["type"] for r in lineage.transformations(held).collect()}
    assert kinds[("c:1", "c:2")] == "extension" and kinds[("a:2", "a:3")] == "poach" and kinds[("c:3", None)] == "release" and (None, "c:4") not in kinds
    walked = {(r["root"], r["node"]): (r["depth"], r["weight"], r["root_kind"]) for r in lineage.closure(lineage.rooted(held), lineage.proceeds_edges(held)).collect()}
    assert walked[("c:1", "a:2")] == (2, 0.75, "salary") and walked[("b:1", "c:3")] == (1, 1.0, "endowment") and walked[("c:4", "c:4")] == (0, 1.0, "derived")
    grades = {(r["trade"], r["team"]): (r["received"], r["outcome"]) for r in lineage.trade_grades(held).collect()}
    assert grades == {(7, 1): (1, "consumed"), (7, 2): (2, "still_held"), (8, 3): (1, "still_held")}


def test_edges_weigh_by_the_share_of_their_target_alone(spark):
    edges = spark.createDataFrame([("h1", "h2", 0.5), ("h2", "h3", 0.4)], "source string, target string, share double")
    nodes = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "node string")
    got = {(r["root"], r["node"]): (r["depth"], r["weight"]) for r in lineage.closure(nodes, edges).collect()}
    assert got == {("h1", "h1"): (0, 1.0), ("h2", "h2"): (0, 1.0), ("h3", "h3"): (0, 1.0), ("h1", "h2"): (1, 0.5), ("h2", "h3"): (1, 0.4), ("h1", "h3"): (2, 0.2)}


@pytest.mark.parametrize("depth", [1, 5, 20])
def test_closure_of_branches_that_meet_and_cycle(spark, depth):
    rng = np.random.default_rng(8)
    edges = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 14, 22), rng.integers(0, 14, 22), rng.random(22) / 2)]
    nodes = [(f"n{i}", i) for i in range(14)]
    got = {(r["root"], r["node"], r["depth"]): (r["tag"], r["weight"]) for r in lineage.closure(spark.createDataFrame(nodes, "node string, tag int"), spark.createDataFrame(edges, "source string, target string, share double"), depth).collect()}
    want: dict = {}
    for node, tag in nodes:
        reach = {node: 1.0}
        for step in range(depth + 1):
            for at, weight in reach.items():
                want[(node, at, step)] = (tag, pytest.approx(weight))
            after: dict = defaultdict(float)
            for a, b, share in edges:
                if a in reach:
                    after[b] += reach[a] * share
            reach = after
    assert got == want


def test_daily_values_by_sweep(spark):
    rng = np.random.default_rng(6)
    day = lambda n: dt.date(2021, 1, 1) + dt.timedelta(int(n))
    states = [(a, d, None if rng.random() < 0.2 else int(rng.integers(0, 3))) for a in range(12) for d in sorted(rng.choice(60, 5, replace=False).tolist())]
    values = [(a, d, int(rng.integers(0, 50))) for a in range(12) for d in sorted(rng.choice(60, 8, replace=False).tolist())]
    got = {(r["team"], r["day"]): r["value"] for r in lineage.daily_values(spark.createDataFrame([(a, day(d), t) for a, d, t in states], "asset int, day date, team int"), spark.createDataFrame([(a, day(d), v) for a, d, v in values], "asset int, day date, value int")).collect()}
    worth = lambda a, d: max(((e, v) for b, e, v in values if b == a and e <= d), default=(0, 0))[1]
    holder = lambda a, d: max(((e, -1 if t is None else t) for b, e, t in states if b == a and e <= d), default=(0, -1))[1]
    assert {team for team, _ in got} == {0, 1, 2}
    for (team, at), value in got.items():
        d = (at - day(0)).days
        assert value == sum(worth(a, d) for a in range(12) if holder(a, d) == team)
    for team in range(3):
        days = sorted(at for own, at in got if own == team)
        assert [(b - a).days for a, b in zip(days, days[1:])] == [1] * (len(days) - 1)


@pytest.mark.parametrize("name", ["player_game_logs", "defence_game_logs", "cohort_share", "opponents_map", "snap_shares", "plays_grouped", "pair_correlations"])
def test_lines_are_dealt_to_tasks_of_bounded_size(spark, name):
    """The number of tasks follows the rows; merged by bytes they grew until one held gigabytes."""
    import contextlib
    import io

    from tidemark.queries import QUERIES
    from tidemark.sources.star import tasks

    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = shown.getvalue()
    assert "REPARTITION_BY_NUM" in plan
    if name in ("player_game_logs", "cohort_share"):
        assert plan.count("lineitem.parquet") == 1
    cores = spark.sparkContext.defaultParallelism
    assert tasks(spark.range(1000), 10) == 100 and tasks(spark.range(1), 10) == tasks(spark.range(0), 10) == cores


def test_dealt_lines_are_not_merged_into_fewer_tasks(spark, monkeypatch):
    """However few bytes the lines of a task have, its rows stay bounded."""
    from tidemark.sources import star

    monkeypatch.setattr(star, "tasks", lambda df: 37, raising=False)
    spark.conf.unset(KEEP_RUNS)  # other shuffles may be merged
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = star.order_lines(spark, "/root/testdata/sf0.001")
        held = [r["count"] for r in lines.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) == 37 and max(held) < 3 * sum(held) / 37


@pytest.mark.parametrize(("name", "lines", "dealt"), [("plays_grouped", 36_000_000, 144), ("plays_grouped", 216_000_000, 200), ("plays_grouped", 600_000_000, 300), ("player_game_logs", 216_000_000, 864)])
def test_small_lines_are_written_unsorted_while_tasks_can_hold_them(spark, monkeypatch, name, lines, dealt):
    """Past 200 tasks a shuffle sorts a whole split in memory, 1,275 MB at 360 x sf0.1; but a task that
    makes wide rows of a million lines takes more than that."""
    import contextlib
    import io

    from tidemark.queries import QUERIES
    from tidemark.sources import star

    monkeypatch.setattr(star, "tasks", lambda df, rows=250_000: -(-lines // rows))
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    parts = [x.split("), ")[0].split(", ")[-1] for x in shown.getvalue().split("hashpartitioning(")[1:] if x.splitlines()[0].count("REPARTITION_BY_NUM")]
    assert parts == [str(dealt)] * 2


def test_holdings_by_windows_and_by_ranges_are_the_same(spark, tmp_path):
    from tidemark.queries_lineage import ORDER, asset_events

    events = asset_events(spark, "/root/testdata/sf0.001")
    ties = events.groupBy("asset", *ORDER).count().filter("count > 1")  # whose order is open
    events = events.join(ties, ["asset", *ORDER], "left_anti")
    events = events.unionByName(events.filter("asset < 20").withColumns({"asset": F.lit(None).cast("long"), "l_suppkey": F.col("l_suppkey") + 1000}))
    found = {}
    for most in (0, 40, 10**9):
        rows = lineage.holdings(events, ORDER, most=most)
        found[most] = sorted(map(str, rows.collect()))
        files = len({f.split("/")[-2] for f in rows.inputFiles()})
        assert files == 1
    assert found[0] == found[40] == found[10**9] and len(found[0]) > 1000 and "asset=None" not in "".join(found[0])

"""Snaps: rows of them against plain Python, the query on odd tables against DuckDB, and its plan."""

import contextlib
import io
from collections import Counter

import duckdb
import pytest

from tidemark.operators import enrichment
from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_snaps_that_come_as_rows(spark):
    """A snap that is there twice, one without a play, a play without snaps, and a player without a team."""
    shape = "game int, play int, offense string, defense string, play_type string, yard_line int, margin int, win_probability double, to_go int, down int"
    plays = [
        (1, 1, "A", "B", "PASS", 5, 3, 0.5, 3, 1), (1, 2, "B", "A", "RUSH", 30, -3, 0.1, 9, 3), (1, 3, "A", "B", "PUNT", 60, 0, 0.3, 8, 2), (1, 4, "A", "B", "NOPL", 60, 0, 0.3, 8, 2),
        (1, 5, None, None, "RUSH", 9, 1, 0.9, 2, 1), (1, 6, "A", "B", "RUSH", 50, 7, 0.7, 7, 3), (1, 7, "A", "B", None, 50, 7, 0.7, 7, 3), (2, 1, "A", "C", "PASS", 15, 3, 0.5, 1, 2),
    ]
    snaps = [(1, 1, 10, "A"), (1, 1, 10, "A"), (1, 1, 20, "B"), (1, 2, 10, "A"), (1, 2, 20, "B"), (1, 3, 10, "A"), (1, 4, 10, "A"), (1, 5, 10, "A"), (1, 7, 10, "A"), (1, 9, 10, "A"), (1, 1, 30, None), (2, 1, 10, "A"), (2, 1, 10, "C")]
    met = enrichment.with_snaps(spark.createDataFrame(plays, shape), spark.createDataFrame(snaps, "game int, play int, player int, team string"), "game", "play")
    got = {(r["game"], r["player"], r["team"]): r for r in enrichment.snap_counts(met, "game").collect()}
    live = {(p[0], p[1]): p for p in plays if p[4] not in (None, "NOPL")}
    own, team = Counter(), Counter()
    for g, n, player, side in set(snaps):
        if (g, n) in live:
            own[(g, player, side, "off")] += live[(g, n)][4] in ("PASS", "RUSH") and side is not None and live[(g, n)][2] == side
            own[(g, player, side, "def")] += live[(g, n)][4] in ("PASS", "RUSH") and side is not None and live[(g, n)][3] == side
    for p in live.values():
        if p[4] in ("PASS", "RUSH"):
            team[(p[0], p[2], "off")] += 1
            team[(p[0], p[3], "def")] += 1
    assert set(got) == {k[:3] for k in own}
    for (g, player, side), r in got.items():
        for kind in ("off", "def"):
            n, of = own[(g, player, side, kind)], team[(g, side, kind)] if side else 0
            assert (r[kind], r[f"{kind}_share"]) == (n, round(n / of, 4) if of else None)
    one = got[(1, 10, "A")]
    assert (one["off"], one["def"], one["special"], one["inside_five"], one["neutral_short"], one["off_share"]) == (1, 1, 1, 1, 1, 0.5)


@pytest.mark.parametrize("name", ["snap_shares", "enriched_plays"])
def test_odd_lines_and_orders(spark, tmp_path, name):
    """Lines that share a play, lines without part, supplier or number, and orders that are there twice."""
    duck = duckdb.connect()
    line = f"FROM '{SF}/lineitem.parquet'"
    tables = {
        "lineitem": f"SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 3 OR l_linenumber > 1 THEN l_partkey END AS l_partkey) {line} UNION ALL SELECT * REPLACE (l_partkey + 10000 AS l_partkey, l_linenumber - 1 AS l_linenumber, 46.0 AS l_quantity) {line} WHERE l_orderkey % 3 = 1 "
        f"UNION ALL SELECT * REPLACE (NULL AS l_suppkey) {line} WHERE l_orderkey % 5 = 2 UNION ALL SELECT * REPLACE (NULL AS l_linenumber) {line} WHERE l_orderkey % 11 = 2",
        "orders": f"FROM '{SF}/orders.parquet' UNION ALL SELECT * REPLACE (o_custkey + 1 AS o_custkey) FROM '{SF}/orders.parquet' WHERE o_orderkey % 9 = 4",
        "customer": f"SELECT * REPLACE (nullif(c_nationkey, 7) AS c_nationkey) FROM '{SF}/customer.parquet'",
    }
    for table, rows in tables.items():
        duck.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
        duck.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
    wanted = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    found = QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    rows = sorted(map(str, wanted.fetchall()))
    assert len(rows) > 5000 and rows == sorted(str(tuple(r)) for r in found)


def test_lines_are_read_and_dealt_once(spark):
    """Snaps were dealt by game and play, then by game and team, and lines for each of six uses."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES["snap_shares"](spark, SF).explain()
    plan = shown.getvalue()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_a_crowded_game_has_no_list_of_pairs_compared_two_by_two(spark, tmp_path):
    """An order of 2,000 lines and 250 suppliers equals the SQL; its pairs of player and team are distinct as they are made."""
    duck = duckdb.connect()
    crowd = f"SELECT * REPLACE (50 + i % 8 * (i % 3 // 2) AS l_orderkey, i % 250 AS l_suppkey, i % 5 + 1 AS l_linenumber) FROM (SELECT *, row_number() OVER () AS i FROM '{SF}/lineitem.parquet' LIMIT 2000)"
    for table, rows in {"lineitem": crowd, "orders": f"FROM '{SF}/orders.parquet'", "customer": f"FROM '{SF}/customer.parquet'"}.items():
        duck.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
        duck.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
    wanted = duck.execute(ORACLE_SQL["snap_shares"])
    columns = [c[0] for c in wanted.description]
    found = QUERIES["snap_shares"](spark, str(tmp_path)).select(columns)
    assert sorted(map(str, wanted.fetchall())) == sorted(str(tuple(r)) for r in found.collect())
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        found.explain()
    assert "array_distinct(flatten" not in shown.getvalue()

"""Settlement, enrichment, stat codes and values of analog years on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stat_codes import DEFENCE_LINE, PLAYER_LINE, coded_lines
from tidemark.operators import boundaries, enrichment, settlement


def test_results_of_each_side(spark):
    rows = [(5.0, 4.0, "OVER", None, "WON"), (5.0, 5.0, "UNDER", None, "PUSH"), (5.0, 6.0, "UNDER", None, "WON"), (2.0, None, "YES", 2.0, "WON"), (1.0, None, "YES", 2.0, "LOST"), (1.0, None, "NO", 2.0, "WON"), (None, 4.0, "OVER", None, None), (5.0, None, "OVER", None, None), (5.0, 4.0, "ODD", None, None)]
    df = spark.createDataFrame(rows, "value double, line double, side string, least double, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", settlement.result(*map(F.col, ("value", "line", "side", "least")))).collect())
    with pytest.raises(ValueError):
        settlement.Market((("a", "b"),), first=True, least=1)


def test_markets_of_subjects_and_games(spark):
    plays = spark.createDataFrame([(1, 1, 10, 20, 5, False), (1, 2, 10, 21, 7, True), (1, 3, None, 20, None, True), (2, 1, 10, 20, 1, False)], "game int, n int, passer int, target int, yards int, score boolean")
    markets = {"yards": settlement.Market((("target", "yards"),)), "both": settlement.Market((("passer", "yards"), ("target", "yards"))), "long": settlement.Market((("target", "yards"),), most=True), "scored": settlement.Market((("target", "score"),), least=1), "first": settlement.Market((("target", "true"),), "score", first=True)}
    got = {(r["game"], r["subject"], r["market"]): r["value"] for r in settlement.measured(plays, "game", ["n"], markets).collect()}
    assert (got[(1, 20, "yards")], got[(1, 10, "yards")], got[(1, 10, "both")], got[(1, 20, "long")], got[(1, 20, "scored")]) == (5.0, 0.0, 12.0, 5.0, 1.0)
    assert (got[(1, 21, "first")], got[(1, 20, "first")], got[(2, 20, "first")]) == (1.0, 0.0, 0.0) and len(got) == 5 * 5
    asked = spark.createDataFrame([(1, 20, "yards", "OVER", 4.5), (1, 99, "yards", "OVER", 4.5), (1, 20, "other", "OVER", 4.5)], "game int, subject long, market string, side string, line double")
    assert [r["result"] for r in settlement.settled(asked, plays, "game", ["n"], markets).orderBy(F.desc("market"), "subject").collect()] == ["WON", None, None]


def test_softened_lines(spark):
    rows = [(100.0, "passing_yards", 94.0), (400.0, "passing_yards", 384.0), (50.0, "rushing_yards", 44.0), (20.0, "targets", 17.0), (20.0, "none", 20.0)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(rows, "line double, market string, want double").withColumn("got", settlement.softened(F.col("line"), F.col("market"))).collect())


def test_play_types_and_drives(spark):
    shape = "game int, n int, possession string, description string, tracked_type string, league_type string, down int, to_go int, gained int, drive int, is_pass boolean, is_rush boolean"
    rows = [
        (1, 1, "A", "pass to the left", "play_type_pass", "RUSH", 1, 10, 4, 1, True, False), (1, 2, "A", "run. NO PLAY", "play_type_rush", "RUSH", 2, 6, 3, 1, False, True), (1, 3, "B", None, None, "TIMEOUT", None, None, None, 1, None, None),
        (1, 4, "B", "QB Kneels", "what", "RUSH", 3, 3, 3, None, False, True), (1, 5, None, "Two-Point Conversion Attempt, Enforced Between Downs", "play_type_pass", "PASS", 4, 1, 0, 1, True, False), (2, 6, "A", "spiked", None, "PASS", 1, 0, 5, 1, True, False),
    ]
    games = spark.createDataFrame([(1, "A", "B"), (2, "A", None)], "game int, home string, away string")
    got = {r["n"]: r for r in enrichment.enriched(spark.createDataFrame(rows, shape), games, "game").collect()}
    assert [got[i]["play_type"] for i in range(1, 7)] == ["PASS", "NOPL", "NOPL", "RUSH", "CONV", "PASS"]
    assert [got[i]["defense"] for i in range(1, 7)] == ["B", "B", "A", "A", None, None]
    assert got[4]["is_qb_kneel"] and got[6]["is_qb_spike"] and not got[1]["is_qb_kneel"]
    assert [got[i]["is_success"] for i in range(1, 7)] == [True, False, None, True, False, None]
    assert [got[i]["drive_play_count"] for i in range(1, 7)] == [2, 2, 2, None, 2, 1]
    with pytest.raises(ValueError, match="unknown steps"):
        enrichment.enriched(spark.createDataFrame(rows, shape), games, "game", ("nothing",))


def test_lines_from_codes(spark):
    shape = "who int, stat_id int, stat_yards int, is_first_down boolean, is_qb_kneel boolean, yard_line_100 int, depth_of_target int, own boolean"
    rows = [(1, 10, 7, True, None, 3, None, True), (1, 11, -2, True, True, 2, None, True), (1, 12, 4, None, False, None, None, None), (1, 70, 52, None, None, None, None, False), (1, 70, 10, None, None, None, None, True), (1, 115, None, None, None, 20, None, None), (2, 999, 1, None, None, None, None, None)]
    lines = {r["who"]: r for r in coded_lines(spark.createDataFrame(rows, shape), ["who"], PLAYER_LINE).collect()}
    one = lines[1]
    assert (one["rushing_attempts"], one["rushing_yards"], one["rushing_yards_excluding_kneels"], one["rushing_first_downs"], one["rushing_first_downs_excluding_touchdowns"], one["longest_rush"]) == (2, 9, 11, 2, 1, 7)
    assert (one["field_goal_yards"], one["field_goals_made_50_plus_yards"], one["field_goals_made_0_19_yards"], one["redzone_targets"], one["targeted_air_yards"]) == (82, 1, 1, 1, 0)
    assert not any(v for k, v in lines[2].asDict().items() if k != "who")
    defence = coded_lines(spark.createDataFrame(rows, shape), ["who"], DEFENCE_LINE).filter("who = 1").first()
    assert (defence["points_against"], defence["yards_against"]) == (9, 9)


def test_values_of_analog_years(spark):
    day = dt.date
    series = spark.createDataFrame([(2022, 1, day(2021, 1, 1), 10), (2022, 1, day(2021, 12, 31), 20), (2023, 1, day(2022, 6, 1), 30), (2023, 1, day(2022, 8, 1), 40), (2025, 2, day(2024, 3, 1), 50)], "y int, k int, d date, v int")
    asked = spark.createDataFrame([(1, 2022, 1, day(2021, 5, 1)), (2, 2024, 1, day(2023, 7, 1)), (3, 2024, 2, day(2023, 2, 1)), (4, 2028, 2, day(2027, 3, 1)), (5, 2022, 1, day(2020, 12, 31)), (6, 2024, 9, day(2023, 7, 1))], "i int, y int, k int, at date")
    got = {r["i"]: (r["v"], r["known"]) for r in boundaries.asof_or_analog(asked, series, "i", "y", ["k"], "at", "d", "v").collect()}
    assert got == {1: (10, "exact"), 2: (10, "analog"), 3: (None, None), 4: (50, "analog"), 5: (None, None), 6: (None, None)}
    moments = spark.range(1).select(boundaries.same_day(F.lit(day(2024, 2, 29)), F.lit(2023)).alias("a"), boundaries.moment_of_year(F.lit(2023), 2, 30).alias("b"), boundaries.moment_of_opening(F.lit(day(2023, 9, 7)), 1, F.lit(day(2024, 1, 1))).alias("c")).first()
    assert tuple(moments) == (day(2023, 3, 1), day(2023, 3, 2), day(2024, 1, 1))


def test_counts_of_settled_selections(spark):
    plays = spark.createDataFrame([(g, n, 10 + g % 3, 20 + n % 2, 5 * n + g, n % 3 == 1) for g in range(9) for n in range(1, 5)] + [(9, 1, 10, None, 4, True), (9, 2, None, 21, 4, True)], "game int, n int, passer int, target int, yards int, score boolean")
    markets = {"yards": settlement.Market((("target", "yards"), ("passer", "yards"))), "scored": settlement.Market((("target", "score"),), least=1), "first": settlement.Market((("passer", "yards > 5"), ("target", "true")), "score", first=True)}
    even, line = F.col("subject") % 2 == 0, F.when(F.col("subject") % 3 == 0, 26.0).otherwise(32.0)
    asked = {n: (F.when(even, a).otherwise(b), line) for n, a, b in (("yards", "OVER", "UNDER"), ("scored", "YES", "NO"), ("first", "YES", "NO"), ("other", "OVER", "UNDER"))}
    values = settlement.game_values(plays, "game", ["n"], markets)
    got = {(r["market"], r["subject"]): tuple(r)[2:] for r in settlement.settled_counts(values, asked, markets).collect()}
    picks = [values.select("game", "subject", F.lit(n).alias("market"), side.alias("side"), at.alias("line")) for n, (side, at) in asked.items()]
    want: dict = {}
    for pick in picks:
        for r in settlement.settled(pick, plays, "game", ["n"], markets).collect():
            side, n, won, lost, pushed, total = want.get((r["market"], r["subject"]), (r["side"], 0, 0, 0, 0, None))
            known = r["result"]
            want[(r["market"], r["subject"])] = (side, n + 1, won + (known == "WON"), lost + (known == "LOST"), pushed + (known == "PUSH"), total if r["value"] is None else (total or 0.0) + r["value"])
    assert got == want and len(got) == 4 * 5 and any(pushed for *_, pushed, _ in got.values()) and got[("other", 20)][2:] == (0, 0, 0, None)


def test_market_kinds_shuffles_lines_once_and_counts_after(spark):
    """A row for each market of each subject and game was shuffled twice before."""
    import contextlib
    import io

    from tidemark.queries import QUERIES

    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES["market_kinds"](spark, "/root/testdata/sf0.001").explain()
    plan = shown.getvalue()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") == 3 and plan.count("REPARTITION_BY_NUM") == 2
    assert plan.index("Generate inline") < plan.index("Exchange")


def test_days_asked_by_many_rows_are_looked_up_once(spark, monkeypatch):
    day = dt.date
    series = spark.createDataFrame([(2022, 1, day(2021, 1, 1), 10), (2022, 1, day(2021, 12, 31), 20)], "y int, k int, d date, v int")
    moments = [(2022, 1, day(2021, 5, 1)), (2024, 1, day(2023, 7, 1)), (2022, None, day(2021, 5, 1)), (None, 1, day(2021, 5, 1))]
    asked = spark.createDataFrame([(i, *moments[i % 4]) for i in range(400)] + [(7, *moments[0])], "i int, y int, k int, at date")
    looked_up = []
    asof = boundaries.asof_join
    monkeypatch.setattr(boundaries, "asof_join", lambda left, *rest: looked_up.append(left.count()) or asof(left, *rest))
    got = boundaries.asof_or_analog(asked, series, "i", "y", ["k"], "at", "d", "v")
    assert looked_up == [4, 1] and got.columns == ["i", "y", "k", "at", "v", "known"]
    want = [(10, "exact"), (10, "analog"), (None, None), (None, None)]
    rows = sorted((r["i"], r["y"] or 0, r["k"] or 0, r["v"] or 0, r["known"] or "") for r in got.collect())
    assert rows == sorted((i, y or 0, k or 0, want[n][0] or 0, want[n][1] or "") for i, n in [*((i, i % 4) for i in range(400)), (7, 0)] for y, k, _ in [moments[n]])

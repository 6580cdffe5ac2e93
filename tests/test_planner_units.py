"""What the planner refuses and looks up, filters by operator, and the append sink."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import model
from tidemark.plans.model import Accumulator, Catalog, Filter, Measure, Output, RateUnit, ViewColumn, ViewRequest, filtered
from tidemark.plans.view import plan_view
from tidemark.sources.files import append
from tidemark.sources.star import play_measures, rate_units, star_catalog

SF = "/root/testdata/sf0.001"


def test_units_and_grains_that_do_not_go_together(spark):
    catalog = star_catalog(spark, SF)
    with pytest.raises(ValueError, match="does not go with grain"):
        plan_view(catalog, ViewRequest((ViewColumn("revenue", Output("rate", "player_play")),), grain="team"))
    with pytest.raises(ValueError, match="unknown unit"):
        plan_view(catalog, ViewRequest((ViewColumn("revenue", Output("rate", "nothing")),)))
    with pytest.raises(ValueError, match="unknown unit"):
        plan_view(catalog, ViewRequest((ViewColumn("revenue", Output("mean", "team_play")),)))
    for bad in ({"kind": "other"}, {"kind": "role"}, {"kind": "team", "roles": (("a", "b"),)}, {"kind": "field", "distinct": "x"}):
        with pytest.raises(ValueError):
            RateUnit(**bad)
    assert len(rate_units()) == 20 and len({m.name for m in play_measures()}) == 45


def test_a_fact_gets_what_is_named_and_no_more(spark):
    catalog = star_catalog(spark, SF)
    assert "c_nationkey" not in catalog.facts(["o_custkey", "l_extendedprice"]).columns
    assert "c_nationkey" in catalog.facts(["struct(c_nationkey, year)"]).columns and "s_nationkey" not in catalog.facts(["c_nationkey"]).columns


def test_a_largest_value_is_not_pooled_over_years(spark):
    with pytest.raises(ValueError, match="additive"):
        plan_view(star_catalog(spark, SF), ViewRequest((ViewColumn("longest_rush", year_offset=(-1, 0)),), axes=("year",), years=(1996,)))


def test_filters_of_each_operator(spark):
    rows = [(1, True, "Ab", [1, 2]), (2, False, "cab", [3]), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, flag boolean, name string, tags array<int>")
    found = lambda *f: [r["k"] for r in filtered(df, f).orderBy("k").collect()]
    assert found(Filter("flag", "=", True)) == [1] and found(Filter("flag", "!=", True)) == [2] and found(Filter("flag", "=", False)) == [2] and found(Filter("flag", "IN", (False,))) == [2]
    assert found(Filter("flag", "IS NULL")) == [3] and found(Filter("flag", "IS NOT NULL")) == [1, 2] and found(Filter("flag", "=", None)) == [1, 2, 3]
    assert found(Filter("name", "LIKE", "ab")) == [2] and found(Filter("name", "ILIKE", "ab")) == [1, 2] and found(Filter("name", "NOT LIKE", "ab")) == [1] and found(Filter("name", "NOT ILIKE", "ab")) == []
    assert found(Filter("tags", "HAS", 3)) == [2] and found(Filter("tags", "OVERLAPS", (2, 9))) == [1] and found(Filter("k", "BETWEEN", (3, 2))) == [2, 3] and found(Filter("k", "NOT IN", (1,))) == [2, 3]
    with pytest.raises(ValueError, match="unknown operator"):
        Filter("k", "~", 1).apply()


def test_facts_that_do_not_count(spark):
    fact = spark.createDataFrame([(1, "A", 5), (1, "N", 7), (1, None, 9), (2, "N", 1)], "who int, kind string, v int").withColumn("year", F.lit(1996))
    people = spark.createDataFrame([(1,), (2,)], "id int")
    catalog = Catalog(fact, {"player": (people, "id", ())}, {"player": "who"}, units={"kind": "kind"}, live="kind <> 'N'")
    catalog.register(Measure("v", Accumulator("v_sum", "sum", "v")))
    rows = plan_view(catalog, ViewRequest((ViewColumn("v"), ViewColumn("v", Output("rate", "kind"))))).collect()
    assert {r["subject"]: (r["v_0"], r["v_1"]) for r in rows} == {1: (5.0, 5.0), 2: (None, None)}


def test_append(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    append(spark.createDataFrame([(1, "a")], "k int, s string"), path)
    append(spark.createDataFrame([("b", 2)], "s string, k int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="the table has"):
        append(spark.createDataFrame([("3", "c")], "k string, s string"), path)


def test_outputs_can_be_registered(spark):
    with pytest.raises(ValueError, match="registered already"):
        model.period_output("mean")(lambda value, output: value)
    with pytest.raises(ValueError, match="unknown output"):
        Output("spread", "game")
    model.period_output("spread")(lambda value, output: F.max(value) - F.min(value))
    try:
        fact = spark.createDataFrame([(1, 1, 5), (1, 1, 1), (1, 2, 9), (2, 3, 4)], "who int, game int, v int").withColumn("year", F.lit(1996))
        catalog = Catalog(fact, {"player": (spark.createDataFrame([(1,), (2,), (3,)], "id int"), "id", ())}, {"player": "who"}, units={"game": "game"})
        catalog.register(Measure("v", Accumulator("v_sum", "sum", "v")))
        rows = plan_view(catalog, ViewRequest((ViewColumn("v", Output("spread", "game")), ViewColumn("v", Output("most", "game"))))).collect()
        assert {r["subject"]: (r["v_0"], r["v_1"]) for r in rows} == {1: (3.0, 9.0), 2: (0.0, 4.0), 3: (None, None)}
    finally:
        model.PERIOD_OUTPUTS.pop("spread")


def test_no_function_is_defined_twice():
    import ast
    from collections import Counter
    from pathlib import Path

    import tidemark

    for file in Path(tidemark.__file__).parent.rglob("*.py"):
        names = Counter(node.name for node in ast.parse(file.read_text()).body if isinstance(node, (ast.FunctionDef, ast.ClassDef)))
        assert [n for n, k in names.items() if k > 1] == [], file


def test_both_speed_scores(spark):
    from tidemark.functions import scalar

    row = spark.range(1).select(
        scalar.plain_speed_score(F.lit(200), F.lit(4.5)).alias("plain"), scalar.plain_speed_score(F.lit(200), F.lit(0)).alias("none"),
        scalar.speed_score(F.lit(200), F.lit(4.5), F.lit(73), F.lit("WR")).alias("by_height"),
    ).first()
    assert (row["plain"], row["none"], row["by_height"]) == (97.55, None, 97.55)

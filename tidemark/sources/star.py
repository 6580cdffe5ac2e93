"""The supplied tables as a star: order lines are plays, orders are games, customers are players,
nations are teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.ordered import tasks
from tidemark.plans.model import Accumulator, Catalog, Measure, OnField, RateUnit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Dealt to more tasks than this, what a task writes is sorted in its memory first
#: (Spark's ``spark.shuffle.sort.bypassMergeThreshold``), a whole split of a file at once.
UNSORTED = 200


def by_order(spark: SparkSession, sf_dir: str, lines: DataFrame, orders: DataFrame, most: int = 250_000) -> DataFrame:
    """Lines (``l_orderkey``) with their order (``o_orderkey``), an order's lines in one task of bounded
    size, so that what is grouped by the order, or by it and more, is shuffled no further. Where
    what a task makes of its lines is small, they may be more, up to ``most``, before there are more
    tasks than are written unsorted."""
    whole = table(spark, sf_dir, "lineitem")
    n = tasks(whole)
    if n > UNSORTED:
        n = max(UNSORTED, tasks(whole, most))
    return lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def order_lines(spark: SparkSession, sf_dir: str, most: int = 250_000) -> DataFrame:
    """Lines with their order's customer and calendar. Money is decimal, so sums are exact."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), (F.floor((F.dayofyear("o_orderdate") - 1) / 7) + 1).cast("int").alias("week"), "o_orderdate", "o_orderpriority"
    )
    lines = table(spark, sf_dir, "lineitem")
    money = {c: F.col(c).cast("decimal(18,2)") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    return by_order(spark, sf_dir, lines.withColumns(money), orders, most).drop("l_orderkey")


#: Kinds of plays among the lines; other lines are no plays.
PLAY, PASS, RUSH = "l_returnflag IN ('A', 'R')", "l_returnflag = 'A'", "l_returnflag = 'R'"


#: Parts of plays: what makes a pass caught, intercepted or a sack, and a gain a score.
CAUGHT, INTERCEPTED, SACKED = f"{PASS} AND l_linestatus = 'F'", f"{PASS} AND l_linestatus = 'O' AND l_tax >= 0.07", f"{PASS} AND l_linestatus = 'O' AND l_tax < 0.01"
DEEP, SCORED, FIRST, LONG = "l_quantity >= 20", "l_quantity >= 46", "l_quantity >= 10", "l_quantity >= 40"
AIR, AFTER = "l_linenumber", "l_quantity - l_linenumber"


def play_measures() -> list[Measure]:
    """Measures of plays: counts and sums of the plays of a kind, largest gains, and quotients of them.

    They hold for whoever the view's subject is: a customer's passes are those it made, a supplier's
    those thrown to it. A quotient names two of the sums; percentages are scaled by 100.
    """
    count = lambda name, where: Accumulator(name, "count", f"CASE WHEN {where} THEN 1 END")
    total = lambda name, where, value: Accumulator(name, "sum", f"CASE WHEN {where} THEN {value} END")
    most = lambda name, where: Accumulator(name, "max", f"CASE WHEN {where} THEN l_quantity END")
    sums = [
        count("pass_attempts", PASS), count("pass_completions", CAUGHT), total("pass_yards", CAUGHT, "l_quantity"), count("pass_touchdowns", f"{CAUGHT} AND {SCORED}"), count("interceptions", INTERCEPTED), count("sacks", SACKED),
        total("pass_air_yards", PASS, AIR), total("completed_air_yards", CAUGHT, AIR), total("yards_after_catch", CAUGHT, AFTER), count("deep_attempts", f"{PASS} AND {DEEP}"), count("deep_completions", f"{CAUGHT} AND {DEEP}"), count("pass_first_downs", f"{CAUGHT} AND {FIRST}"), most("longest_pass", CAUGHT),
        count("rush_attempts", RUSH), total("rush_yards", RUSH, "l_quantity"), count("rush_touchdowns", f"{RUSH} AND {SCORED}"), count("rush_first_downs", f"{RUSH} AND {FIRST}"), count("stuffed_rushes", f"{RUSH} AND l_quantity < 3"), count("explosive_rushes", f"{RUSH} AND {LONG}"), most("longest_rush", RUSH),
        count("plays", PLAY), total("scrimmage_yards", f"{CAUGHT} OR {RUSH}", "l_quantity"), count("touchdowns", f"({CAUGHT} OR {RUSH}) AND {SCORED}"), count("first_downs", f"({CAUGHT} OR {RUSH}) AND {FIRST}"), count("explosive_plays", f"({CAUGHT} OR {RUSH}) AND {LONG}"),
    ]
    by_name = {a.name: a for a in sums}
    quotients = {
        "completion_pct": ("pass_completions", "pass_attempts", 100), "pass_yards_per_attempt": ("pass_yards", "pass_attempts", 1), "pass_yards_per_completion": ("pass_yards", "pass_completions", 1), "pass_touchdown_pct": ("pass_touchdowns", "pass_attempts", 100),
        "interception_pct": ("interceptions", "pass_attempts", 100), "sack_pct": ("sacks", "pass_attempts", 100), "air_yards_per_attempt": ("pass_air_yards", "pass_attempts", 1), "air_conversion": ("pass_yards", "pass_air_yards", 1), "yards_after_catch_share": ("yards_after_catch", "pass_yards", 100),
        "deep_attempt_pct": ("deep_attempts", "pass_attempts", 100), "deep_completion_pct": ("deep_completions", "deep_attempts", 100), "pass_first_down_pct": ("pass_first_downs", "pass_attempts", 100), "rush_yards_per_attempt": ("rush_yards", "rush_attempts", 1),
        "rush_first_down_pct": ("rush_first_downs", "rush_attempts", 100), "stuffed_pct": ("stuffed_rushes", "rush_attempts", 100), "explosive_rush_pct": ("explosive_rushes", "rush_attempts", 100), "yards_per_play": ("scrimmage_yards", "plays", 1), "first_down_pct": ("first_downs", "plays", 100), "explosive_pct": ("explosive_plays", "plays", 100),
        "touchdown_pct": ("touchdowns", "plays", 100),
    }
    return [Measure(a.name, a) for a in sums] + [Measure(n, by_name[top], by_name[bottom], float(scale)) for n, (top, bottom, scale) in quotients.items()]


def rate_units() -> dict[str, RateUnit]:
    """Denominators by the plays of the team, by the subject's part in plays, and by roles.

    A returned line is a rush of its customer, an accepted one a pass from its customer to its
    supplier, caught if it is filled and deep from 20 pieces on.
    """
    whole = "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END"
    team = {"play": (PLAY, None), "pass_play": (PASS, None), "rush_play": (RUSH, None), "half": (PLAY, whole), "quarter": (PLAY, "l_linenumber % 4"), "drive": (PLAY, "o_orderkey"), "series": (PLAY, "struct(o_orderkey, l_suppkey)")}
    units = {f"team_{n}": RateUnit("team", where, distinct) for n, (where, distinct) in team.items()}
    deep, caught = f"{PASS} AND l_quantity BETWEEN 20 AND 99", "l_linestatus = 'F'"
    rush, target, reception = ("o_custkey", RUSH), ("l_suppkey", PASS), ("l_suppkey", f"{PASS} AND {caught}")
    roles = {
        "rush_attempt": (rush,), "pass_attempt": (("o_custkey", PASS),), "target": (target,), "catchable_target": (reception,), "deep_target": (("l_suppkey", deep),), "catchable_deep_target": (("l_suppkey", f"{deep} AND {caught}"),),
        "reception": (("l_suppkey", f"{PASS} AND {caught} AND l_discount > 0"),), "touch": (rush, reception), "opportunity": (rush, target),
    }
    units |= {f"player_{n}": RateUnit("role", roles=own) for n, own in roles.items()}
    fields = {"play": PLAY, "pass_play": PASS, "rush_play": RUSH, "route": f"{PASS} AND l_quantity > 5"}
    return units | {f"player_{n}": RateUnit("field", where) for n, where in fields.items()}


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier")
    catalog = Catalog(
        fact=order_lines(spark, sf_dir),
        dimensions={"player": (customers, "c_custkey", ("c_name", "c_mktsegment")), "team": (nations, "n_nationkey", ("n_name", "r_name")), "receiver": (suppliers, "s_suppkey", ("s_name",))},
        subjects={"player": "o_custkey", "team": "c_nationkey", "receiver": "l_suppkey"},
        lookups={"c_nationkey": (customers, "c_custkey", "o_custkey"), "s_nationkey": (suppliers, "s_suppkey", "l_suppkey")},
        teams={"player": "c_nationkey", "team": "c_nationkey", "receiver": "s_nationkey"},
        on_field=OnField("o_orderkey", "l_suppkey", "l_linenumber"),
        rate_units=rate_units(),
        units={"game": "o_orderkey", "season": "year", "series": "struct(o_orderkey, l_suppkey)", "drive": "struct(o_orderkey, l_returnflag)"},
        parts_of_game={"series": "l_suppkey", "drive": "l_returnflag"},
        around_game=("season",),
        dated="o_orderdate",
    )
    gross = Accumulator("gross", "sum", "l_extendedprice")
    catalog.register(Measure("revenue", gross))
    catalog.register(Measure("lines", Accumulator("n_lines", "count", "l_linenumber")))
    catalog.register(Measure("parts", Accumulator("n_parts", "count_distinct", "l_partkey")))
    catalog.register(Measure("discount_share", Accumulator("discounted", "sum", "l_extendedprice * l_discount"), gross, 100.0, 2))
    for measure in play_measures():
        catalog.register(measure)
    catalog.register(Measure("mean_quantity", Accumulator("quantity", "sum", "l_quantity"), Accumulator("n_lines", "count", "l_linenumber")))
    return catalog

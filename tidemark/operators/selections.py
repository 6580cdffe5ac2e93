"""Combinations of selections: joint hits up to a size, round robins, wagers by odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.storage import Workspace

#: Upper bounds of American odds, with the names of the ranges below them.
ODDS_RANGES = (
    (100, "under_100"), (400, "range_100_400"), (1_000, "range_400_1000"), (10_000, "range_1000_10000"), (50_000, "range_10000_50000"), (100_000, "range_50000_100000"),
    (150_000, "range_100000_150000"), (250_000, "range_150000_250000"), (500_000, "range_250000_500000"), (1_000_000, "range_500000_1000000"),
)


def combinations(hits: DataFrame, group: list[str], item: str, at: str, most: int, support: int) -> DataFrame:
    """(group, size, items, together, bits): sets of 2 to ``most`` items of a group that hit together
    at ``support`` of the group's moments or more.

    ``hits`` has a row for each item and moment ``at`` (0 to 63) at which it hit; repeats count once.
    Moments are a bit each, so that a set's are the bitwise and of its items'. Sets grow level by
    level: two that share all but their last item make one of the next size, and only where each is
    supported, since no set hits more often than a part of it. A group's sets thus never get beyond
    the neighbours of supported ones. Items of ``items`` ascend.
    """
    space = Workspace(hits.sparkSession, "combinations")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(at).cast("int"))
    level = hits.filter(F.col(item).isNotNull()).groupBy(*group, F.col(item).alias("last")).agg(F.bit_or(bit).alias("bits")).filter(F.bit_count("bits") >= support)
    level = space.save(level.withColumn("head", F.array().cast("array<string>")).withColumn("last", F.col("last").cast("string")), "level-1")
    found = None
    for size in range(2, most + 1):
        more = level.select(*group, "head", F.col("last").alias("next"), F.col("bits").alias("_bits"))
        met = level.join(more, [*group, "head"]).filter("last < next").withColumn("bits", F.col("bits").bitwiseAND(F.col("_bits")))
        grown = met.filter(F.bit_count("bits") >= support).select(*group, F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last"), "bits")
        level = space.save(grown, f"level-{size}")
        rows = level.select(*group, F.lit(size).alias("size"), F.concat("head", F.array("last")).alias("items"), F.bit_count("bits").cast("long").alias("together"), "bits")
        found = rows if found is None else found.unionByName(rows)
        if level.isEmpty():
            break
    return found


def combined_probability(odds: Column) -> Column:
    """Of an array of implied probabilities: one less the product of what each leaves."""
    return 1 - F.aggregate(odds, F.lit(1.0), lambda acc, p: acc * (1 - p))


def symmetric_sums(values: Column, most: int) -> Column:
    """Elementary symmetric polynomials e_0 to e_most of an array of doubles: the sums of the products
    of all its subsets of so many elements, without listing the subsets."""
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), most))
    return F.aggregate(values, start, lambda acc, x: F.zip_with(acc, F.concat(F.array(F.lit(0.0)), F.slice(acc, 1, most)), lambda same, less: same + less * x))


def round_robins(legs: DataFrame, wager: str, state: str, odds: str, sizes: tuple[int, ...]) -> DataFrame:
    """(wager, size, parlays, potential, returned) of all parlays of ``sizes`` legs that a wager's
    legs make: how many, what they would return at a stake of one each, and what they have returned.

    A lost leg returns nothing, a push its stake, a won leg its decimal odds; a leg without a state
    has returned nothing yet. A wager's legs are one array; sums are polynomials over it, so no
    parlay is listed. Wagers of fewer legs than a size have no row of it.
    """
    price = F.col(odds).cast("double")
    paid = F.when(F.col(state) == "WON", price).when(F.col(state) == "PUSH", 1.0).otherwise(0.0)
    most = max(sizes)
    # Sorted, so that the sums come out alike whatever the order of rows.
    own = legs.groupBy(wager).agg(F.array_sort(F.collect_list(F.struct(price.alias("price"), paid.alias("paid")))).alias("legs"))
    sums = own.select(wager, F.size("legs").alias("n"), symmetric_sums(F.transform("legs", lambda x: F.lit(1.0)), most).alias("ones"), symmetric_sums(F.col("legs.price"), most).alias("all"), symmetric_sums(F.col("legs.paid"), most).alias("won"))
    rows = F.array(*[F.struct(F.lit(k).alias("size"), F.get("ones", F.lit(k)).cast("long").alias("parlays"), F.get("all", F.lit(k)).alias("potential"), F.get("won", F.lit(k)).alias("returned")) for k in sizes])
    return sums.select(wager, "n", F.explode(rows).alias("r")).select(wager, "n", "r.*").filter("size <= n").drop("n")


def exposures(legs: DataFrame, wager: str, leg: str, odds: str, size: int) -> DataFrame:
    """(leg, wagers, parlays, potential): of each leg over all wagers, the parlays of ``size`` legs that
    hold it and what they would return. Those with a leg are its odds times the polynomial of the
    others, which follows from that of all: e_k without x is e_k - x * (e_(k-1) without x)."""
    price = F.col(odds).cast("double")
    own = legs.groupBy(wager).agg(F.array_sort(F.collect_list(F.struct(price.alias("price"), F.col(leg).alias("leg")))).alias("legs"))
    sums = own.select(F.explode("legs").alias("l"), F.size("legs").alias("n"), symmetric_sums(F.transform("legs", lambda x: F.lit(1.0)), size).alias("ones"), symmetric_sums(F.col("legs.price"), size).alias("all"))

    def beside(sums: str, x: Column) -> Column:
        less = F.lit(1.0)
        for k in range(1, size):
            less = F.get(F.col(sums), F.lit(k)) - x * less
        return less

    holding = sums.filter(F.col("n") >= size).select(F.col("l.leg").alias(leg), beside("ones", F.lit(1.0)).alias("parlays"), (F.col("l.price") * beside("all", F.col("l.price"))).alias("potential"))
    return holding.groupBy(leg).agg(F.count("*").alias("wagers"), F.sum("parlays").cast("long").alias("parlays"), F.sum("potential").alias("potential"))


def odds_range(odds: Column) -> Column:
    """The name of the range that American odds lie in; null odds count as 0."""
    out = F.lit("over_1000000")
    for bound, name in reversed(ODDS_RANGES):
        out = F.when(F.coalesce(odds, F.lit(0)) < bound, name).otherwise(out)
    return out


def wager_summary(wagers: DataFrame, odds: str, result: str, lost_legs: str, stake: str, returns: str) -> DataFrame:
    """(odds_range, wagers, won, lost, open, risk, returned, highest, lost_by_one) by range of odds.
    What is settled and won returns ``returns``; ``lost_by_one`` wagers lost by a single leg."""
    count = lambda c: F.count(F.when(c, 1))
    return wagers.groupBy(odds_range(F.col(odds)).alias("odds_range")).agg(
        F.count("*").alias("wagers"), count(F.col(result) == "WON").alias("won"), count(F.col(result) == "LOST").alias("lost"), count(F.col(result) == "OPEN").alias("open"),
        F.sum(stake).alias("risk"), F.sum(F.when(F.col(result) == "WON", F.col(returns)).otherwise(F.col(returns) * 0)).alias("returned"), F.max(odds).alias("highest"), count((F.col(result) == "LOST") & (F.col(lost_legs) == 1)).alias("lost_by_one"),
    )

"""Holdings of assets, what they turned into, and walks along the weighted edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ordered import scan, tasks
from tidemark.storage import Workspace

#: Event kinds that open a holding. The others, ``release``, end the holding of their own team.
OPENING = ("acquire", "endow", "move")


#: Events of an asset that one task sorts; assets with more are dealt to several.
MOST = 100_000


def holdings(events: DataFrame, order: list[str], most: int = MOST, counted: DataFrame | None = None) -> DataFrame:
    """Intervals in which a team holds an asset, from a stream of events (asset, kind, team, giver,
    trade, salary, value, at, and the columns of ``order``, which leaves no ties within an asset).

    ``acquire`` (at a salary), ``endow`` and ``move`` (a leg of a trade) open a holding of their team
    and end the one that is open, whoever holds it; ``release`` ends it if its own team holds it, and
    is ignored otherwise. A move takes over the salary of the holding that it ends. An asset's
    holdings are numbered from 1; ``previous`` is the number of the one that an opening ended.

    Assets of up to ``most`` events are shuffled once and done by windows. Of the others openings are
    counted along the asset's order by a scan of ranges, so an asset with any number of events lies in
    many tasks; the events between two openings are one group, aggregated before they are shuffled.
    ``counted`` (asset) may give rows to count that an asset has no fewer of than events, where these
    are cheaper to read. Events of no asset do not count; an empty stream gives no holdings.
    """
    space = Workspace(events.sparkSession, "holdings")
    events = events.filter("asset is not null")
    counted = events if counted is None else counted
    sizes = counted.groupBy("asset").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(F.struct("asset").alias("_large"))
    large = space.save(sizes, "large")
    if large.isEmpty():
        return space.save(_windowed(events, order, counted), "held")
    same = F.struct("asset").eqNullSafe(F.col("_large"))
    small, rest = events.join(F.broadcast(large), same, "left_anti"), events.join(F.broadcast(large), same, "left_semi")
    return space.save(_windowed(small, order, counted).unionByName(_ranged(rest, order)), "held")


def _windowed(events: DataFrame, order: list[str], counted: DataFrame) -> DataFrame:
    """``holdings`` by windows over an asset's events, in one shuffle of them."""
    dealt = events.repartition(tasks(counted), "asset")
    path = Window.partitionBy("asset").orderBy(*order)
    far = path.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind").isin(*OPENING)
    numbered = dealt.withColumns({"number": F.sum(opens.cast("long")).over(far), "_team": F.last(F.when(opens, F.col("team")), ignorenulls=True).over(far)}).filter("number > 0")
    released = (F.col("kind") == "release") & (F.col("team") == F.col("_team"))
    span = Window.partitionBy("asset", "number")
    # Both windows stay in the asset's task; a span's events are those up to the next opening.
    spans = numbered.withColumn("released", F.min(F.when(released, F.col("at"))).over(span)).filter(opens)
    line = Window.partitionBy("asset").orderBy("number")
    next_of = lambda c: F.lead(c).over(line)
    met = spans.withColumns({
        "_next_at": next_of("at"), "_next_kind": next_of("kind"), "_next_team": next_of("team"), "_before": F.lag("team").over(line),
        "previous": F.lag(F.when(F.col("released").isNull(), F.col("number"))).over(line),
    })
    paid = F.when((F.col("kind") != "move") | F.col("previous").isNull(), F.struct(F.when(F.col("kind") == "acquire", F.col("salary")).alias("paid")))
    met = met.withColumn("_paid", F.last(paid, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return met.select(
        "asset", "number", "team", "kind", "giver", "trade", "value", F.col("at").alias("period_start"), F.coalesce("released", "_next_at").alias("period_end"),
        _why(F.col("released"), F.col("_next_kind"), F.col("_next_team"), F.col("team")).alias("terminated_by"), "previous", F.when(F.col("previous").isNotNull(), F.col("_before")).alias("previous_team"), F.col("_paid.paid").alias("salary_paid"),
    )


def _why(released: Column, next_kind: Column, next_team: Column, team: Column) -> Column:
    return (
        F.when(released.isNotNull(), "release").when(next_kind.isNull(), "still_held")
        .when((next_kind == "move") | (next_team != team), "trade").otherwise("extension")
    )


def _ranged(events: DataFrame, order: list[str]) -> DataFrame:
    """``holdings`` by scans of ranges, for assets of any number of events."""
    space = Workspace(events.sparkSession, "holdings")
    opens = F.col("kind").isin(*OPENING)
    opening = F.struct(*order, "at", "team", "kind", "giver", "trade", "salary", "value")
    counted = scan(events, ["asset"], order, sums={"number": opens.cast("long")}, lasts={"opening": F.when(opens, opening)})
    released = (F.col("kind") == "release") & (F.col("team") == F.col("opening.team"))
    spans = counted.filter("number > 0").groupBy("asset", "number").agg(F.max("opening").alias("o"), F.min(F.when(released, F.col("at"))).alias("released"))
    spans = space.save(spans, "spans")
    after = spans.select("asset", (F.col("number") - 1).alias("number"), F.col("o.at").alias("next_at"), F.col("o.kind").alias("next_kind"), F.col("o.team").alias("next_team"))
    before = spans.select("asset", (F.col("number") + 1).alias("number"), F.when(F.col("released").isNull(), F.col("number")).alias("previous"), F.col("o.team").alias("previous_team"))
    met = spans.join(after, ["asset", "number"], "left").join(before, ["asset", "number"], "left")
    why = _why(F.col("released"), F.col("next_kind"), F.col("next_team"), F.col("o.team"))
    rows = met.select(
        "asset", "number", "o.team", "o.kind", "o.giver", "o.trade", "o.value", F.col("o.at").alias("period_start"), F.coalesce("released", "next_at").alias("period_end"), why.alias("terminated_by"),
        "previous", F.when(F.col("previous").isNotNull(), F.col("previous_team")).alias("previous_team"),
        # A salary lasts until another opening sets it or finds nothing to take over.
        F.when((F.col("o.kind") != "move") | F.col("previous").isNull(), F.struct(F.when(F.col("o.kind") == "acquire", F.col("o.salary")).alias("paid"))).alias("_set"),
    )
    return scan(rows, ["asset"], ["number"], lasts={"_paid": F.col("_set")}).withColumn("salary_paid", F.col("_paid.paid")).drop("_set", "_paid")


def named(asset: str = "asset", number: str = "number") -> Column:
    """A holding's name, null without a number."""
    return F.when(F.col(number).isNotNull(), F.concat_ws(":", asset, number))


def transformations(held: DataFrame) -> DataFrame:
    """(source, target, type, at, trade, source_share, target_share) following assets: a row for each
    opening (source NULL where it ended nothing; such moves have none) and for each release."""
    kind = F.when(F.col("kind") == "move", "trade").when((F.col("kind") == "acquire") & (F.col("previous_team") == F.col("team")), "extension").when((F.col("kind") == "acquire") & F.col("previous").isNotNull(), "poach").otherwise(F.col("kind"))
    source = named(number="previous")
    opened = held.filter("kind != 'move' or previous is not null").select(source.alias("source"), named().alias("target"), kind.alias("type"), F.col("period_start").alias("at"), "trade", F.when(F.col("previous").isNotNull(), 1.0).alias("source_share"), F.lit(1.0).alias("target_share"))
    ended = held.filter("terminated_by = 'release'").select(named().alias("source"), F.lit(None).cast("string").alias("target"), F.lit("release").alias("type"), F.col("period_end").alias("at"), F.lit(None).cast("long").alias("trade"), F.lit(1.0).alias("source_share"), F.lit(None).cast("double").alias("target_share"))
    return opened.unionByName(ended)


def considerations(held: DataFrame) -> DataFrame:
    """(source, target, trade, team, source_share, target_share): what a team's given assets became.

    Each holding that a team gave in a trade leads to each that it received there, by the received
    one's part of the value received (``target_share``); ``source_share`` is the given one's part of
    the value given. So shares of a source sum to one, and so do the products of a trade and team.
    A leg counts as given only where its giver did hold the asset. Rows are the product of the two
    sides of one trade, never of more.
    """
    moves = held.filter("kind = 'move'")
    given = moves.filter("previous_team = giver").select("trade", F.col("giver").alias("team"), named(number="previous").alias("source"), F.col("value").alias("gave"))
    received = moves.select("trade", "team", named().alias("target"), F.col("value").alias("got"))
    sums = lambda df, c: df.groupBy("trade", "team").agg(F.sum(c).alias(f"all_{c}"))
    met = given.join(received, ["trade", "team"]).join(sums(given, "gave"), ["trade", "team"]).join(sums(received, "got"), ["trade", "team"])
    share = lambda c: F.col(c).cast("double") / F.col(f"all_{c}").cast("double")
    return met.select("source", "target", "trade", "team", share("gave").alias("source_share"), share("got").alias("target_share"))


def proceeds_edges(held: DataFrame) -> DataFrame:
    """(source, target, share): what a holding became for the team that held it, by trade or by extension."""
    kept = held.filter("kind != 'move' and previous_team = team").select(named(number="previous").alias("source"), named().alias("target"), F.lit(1.0).alias("share"))
    return considerations(held).select("source", "target", F.col("target_share").alias("share")).unionByName(kept)


def rooted(held: DataFrame) -> DataFrame:
    """(node, root_kind): salary, endowment, or derived from something else."""
    kind = F.when(F.col("salary_paid") > 0, "salary").when(F.col("kind") == "endow", "endowment").otherwise("derived")
    return held.select(named().alias("node"), kind.alias("root_kind"))


def closure(nodes: DataFrame, edges: DataFrame, depth: int = 20) -> DataFrame:
    """(root, node, depth, weight): all that is reached from each of ``nodes`` (node, and columns of
    the root that are kept) along ``edges`` (source, target, share) within ``depth`` steps.

    A path weighs the product of its shares; paths of one length between the same ends are summed.
    Lengths double from round to round: paths of up to 2k steps are those of up to k steps, and
    those of just k steps continued by them; a longest length that is no power of two takes one more,
    shorter round (20 steps: five rounds). Edges may branch, meet, repeat and form cycles, which the
    bound ends. Each round is a table, written in the shared folder and dropped when the next one
    holds its rows.
    """
    space = Workspace(nodes.sparkSession, "closure")
    steps = edges.filter("source is not null and target is not null").groupBy(F.col("source").alias("root"), F.col("target").alias("node")).agg(F.sum(F.col("share").cast("double")).alias("weight"))
    found = space.save(steps.select("root", "node", F.lit(1).alias("depth"), "weight"), "paths-1")
    reached = 1
    while reached < depth:
        more = min(reached, depth - reached)
        ends = found.filter(F.col("depth") == reached).select("root", F.col("node").alias("_via"), F.col("weight").alias("_weight"))
        if ends.isEmpty():
            break
        onward = found.filter(F.col("depth") <= more).select(F.col("root").alias("_via"), "node", (F.col("depth") + reached).alias("depth"), "weight")
        longer = ends.join(onward, "_via").groupBy("root", "node", "depth").agg(F.sum(F.col("_weight") * F.col("weight")).alias("weight"))
        found = space.save(found.unionByName(longer.select(*found.columns)), f"paths-{reached + more}")
        space.drop(f"paths-{reached}")
        reached += more
    kept = [c for c in nodes.columns if c != "node"]
    roots = nodes.withColumnRenamed("node", "root")
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("weight"), *kept)
    return start.unionByName(found.join(roots, "root").select(*start.columns))


def trade_grades(held: DataFrame, depth: int = 40) -> DataFrame:
    """(trade, team, received, weight, days_held, salary, outcome) of each side of a trade: what the
    assets received became as long as this team followed them.

    From each holding received, the team's own proceeds are walked to ``depth``; days and salaries of
    the holdings on the way count by the weight that they are reached with. ``still_held`` if the
    team holds one of the last ones, else ``traded_onward`` if one went by trade, else ``consumed``.
    """
    space = Workspace(held.sparkSession, "grades")
    legs = held.filter("kind = 'move'").select("trade", "team", named().alias("node"))
    walked = space.save(closure(legs, proceeds_edges(held), depth), "walked")
    facts = held.select(named().alias("node"), F.date_diff("period_end", "period_start").alias("days"), "salary_paid", "terminated_by")
    met = walked.join(facts, "node")
    weighted = lambda c: F.sum(F.col("weight") * F.coalesce(F.col(c), F.lit(0)).cast("double"))
    ended = lambda k: F.max((F.col("terminated_by") == k).cast("int")) == 1
    outcome = F.when(ended("still_held"), "still_held").when(ended("trade"), "traded_onward").otherwise("consumed")
    return met.groupBy("trade", "team").agg(F.count_distinct("root").alias("received"), F.count("*").alias("reached"), weighted("days").alias("days_held"), weighted("salary_paid").alias("salary"), outcome.alias("outcome"))


def daily_values(states: DataFrame, values: DataFrame) -> DataFrame:
    """(team, day, value): the total value of what each team holds at the end of each day, from its
    first day on to its last change.

    ``states`` (asset, day, team) says who holds an asset from that day on, NULL for nobody;
    ``values`` (asset, day, value) what it is worth from then on, 0 before. A sweep: each day on
    which an asset changes hands or value takes its old value from the old team and gives the new
    one to the new team, and these changes are summed along a team's days. No row is made for a
    holding and day in between.
    """
    at = lambda df, c: df.select("asset", "day", F.struct(c).alias(f"_{c}"))
    points = at(states, "team").join(at(values, "value"), ["asset", "day"], "full")
    filled = scan(points, ["asset"], ["day"], lasts={"team": F.col("_team"), "value": F.col("_value")})
    worth = F.struct(F.col("team.team").alias("team"), F.coalesce("value.value", F.lit(0)).alias("value"))
    moved = scan(filled.select("asset", "day", worth.alias("now")), ["asset"], ["day"], lasts={"was": F.col("now")}, before=True)
    change = F.explode(F.array(F.struct(F.col("was.team").alias("team"), (-F.col("was.value")).alias("change")), F.struct(F.col("now.team").alias("team"), F.col("now.value").alias("change"))))
    changes = moved.select("day", change.alias("c")).filter("c.team is not null").groupBy("c.team", "day").agg(F.sum("c.change").alias("change"))
    totals = scan(changes, ["team"], ["day"], sums={"value": F.col("change")})
    # A total lasts until the day before the next change; a team has a row for each day at most.
    until = F.lead("day").over(Window.partitionBy("team").orderBy("day"))
    days = F.sequence("day", F.coalesce(F.date_sub(until, 1), F.col("day")))
    return totals.withColumn("_days", days).select("team", F.explode("_days").alias("day"), "value")

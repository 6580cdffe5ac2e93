"""Selections of betting markets settled from plays: markets are declared, plays are read once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Market:
    """What a market measures of a subject in a game.

    ``parts`` are pairs of a role column and what a play in which the subject stands there adds (a
    number, or a condition that counts); they are summed, or the largest is taken (``most``).
    ``where`` picks plays. ``first``: instead, whether the subject scored the game's first play for
    which ``where`` holds; the scorer is the first of the parts' columns whose condition holds.
    ``least`` makes it a yes or no: whether the measure reaches it.
    """

    parts: tuple[tuple[str, str], ...]
    where: str = "true"
    most: bool = False
    first: bool = False
    least: int | None = None

    def __post_init__(self):
        if self.first and (self.least is not None or self.most):
            raise ValueError("a first scorer is a yes or no of its own")

    @property
    def yes_or_no(self) -> bool:
        return self.first or self.least is not None


def game_values(plays: DataFrame, game: str, order: list[str], markets: dict[str, Market]) -> DataFrame:
    """(game, subject, a column for each market) of all subjects with a play in a role of some market.

    A play makes a row for each role column; every market is a conditional aggregate over these rows,
    so one pass serves all. A first scorer is the least in the order of its game's plays, which its
    rows carry along. Plays that are dealt by their game already are not shuffled again.
    """
    roles = sorted({column for m in markets.values() for column, _ in m.parts})
    firsts = {n: m for n, m in markets.items() if m.first}
    if firsts:
        scorer = lambda m: F.coalesce(*[F.when(F.expr(condition), F.col(column)) for column, condition in m.parts]).cast("long")
        whole = Window.partitionBy(game)
        plays = plays.withColumns({f"_first_{n}": F.min(F.when(F.expr(m.where), F.struct(*order, scorer(m).alias("_scorer")))).over(whole)["_scorer"] for n, m in firsts.items()})
    cells = {}
    for name, m in markets.items():
        for column in roles:
            own = [F.expr(f"CAST({e} AS DOUBLE)") for c, e in m.parts if c == column and not m.first]
            total = sum(own[1:], own[0]) if own else F.lit(None).cast("double")
            cells[(name, column)] = (F.col(f"_first_{name}") == F.col(column).cast("long")).cast("double") if m.first else F.when(F.expr(m.where), total)
    credits = F.array(*[F.struct(F.col(c).cast("long").alias("subject"), *[cells[(n, c)].alias(n) for n in markets]) for c in roles])
    rows = plays.select(F.col(game).alias("game"), F.explode(credits).alias("c")).select("game", "c.*").filter("subject is not null")
    return rows.groupBy("game", "subject").agg(*[F.coalesce((F.max if m.most or m.first else F.sum)(n), F.lit(0.0)).alias(n) for n, m in markets.items()])


def measured(plays: DataFrame, game: str, order: list[str], markets: dict[str, Market]) -> DataFrame:
    """``game_values`` as rows: (game, subject, market, value)."""
    return game_values(plays, game, order, markets).unpivot(["game", "subject"], list(markets), "market", "value")


def result(value: Column, line: Column, side: Column, least: Column) -> Column:
    """WON, LOST or PUSH of a side (OVER, UNDER, YES or NO); NULL while there is no value, for other
    sides, and over and under without a line."""
    reached = value >= least
    yes = F.when(side == "YES", F.when(reached, "WON").otherwise("LOST")).when(side == "NO", F.when(reached, "LOST").otherwise("WON"))
    above = F.when(value == line, "PUSH").when((value > line) == (side == "OVER"), "WON").otherwise("LOST")
    return F.when(value.isNull(), None).when(side.isin("YES", "NO"), yes).when(side.isin("OVER", "UNDER") & line.isNotNull(), above)


def _least(markets: dict[str, Market], name: str) -> Column:
    """What the measure of a market that is a yes or no has to reach."""
    m = markets.get(name)
    return F.lit(float(1 if m.first else m.least) if m and m.yes_or_no else None).cast("double")


def settled(selections: DataFrame, plays: DataFrame, game: str, order: list[str], markets: dict[str, Market]) -> DataFrame:
    """``selections`` (game, subject, market, side, line) with ``value`` and ``result``. Of markets that
    are not declared, and of subjects without a play in the game, both are NULL."""
    values = game_values(plays, game, order, markets).select("game", "subject", F.struct(*markets).alias("_values"))
    met = selections.join(values, ["game", "subject"], "left")
    of_market = lambda pick: F.coalesce(*[F.when(F.col("market") == n, pick(n)) for n in markets])
    met = met.withColumn("value", of_market(lambda n: F.col("_values")[n])).drop("_values")
    return met.withColumn("result", result(F.col("value"), F.col("line"), F.col("side"), of_market(lambda n: _least(markets, n))))


def settled_counts(values: DataFrame, asked: dict[str, tuple[Column, Column]], markets: dict[str, Market]) -> DataFrame:
    """(market, subject, side, n, won, lost, pushed, total) of a selection of every market ``asked`` for
    each row of ``game_values``. ``asked`` has each market's side and line, which follow from ``subject``;
    markets that are not declared stay unsettled.

    A game of a subject is one row until it is counted, and only the counts become a row for each market.
    """
    unknown = F.lit(None).cast("double")
    counts = []
    for name, (side, line) in asked.items():
        value = F.col(name) if name in markets else unknown
        found = result(value, line, side, _least(markets, name))
        own = [F.count(F.when(found == state, 1)).alias(f"{name}_{c}") for c, state in (("won", "WON"), ("lost", "LOST"), ("pushed", "PUSH"))]
        counts += [*own, F.sum(value).alias(f"{name}_total")]
    cells = [F.struct(F.lit(name).alias("market"), "subject", side.alias("side"), "n", *[F.col(f"{name}_{c}").alias(c) for c in ("won", "lost", "pushed", "total")]) for name, (side, _) in asked.items()]
    return values.groupBy("subject").agg(F.count("*").alias("n"), *counts).select(F.inline(F.array(*cells)))


# By how much a line is softened, as a share of it and at most so much.
CUSHIONS: dict[str, tuple[float, int | None]] = {
    "passing_yards": (0.06, 16), "rushing_yards": (0.12, 9), "receiving_yards": (0.12, 9), "passing_touchdowns": (0.15, None), "passing_rushing_yards": (0.06, 20), "targets": (0.15, None),
    "first_quarter_passing_yards": (0.06, 8), "first_quarter_rushing_yards": (0.12, 5), "first_quarter_receiving_yards": (0.12, 5), "first_half_passing_yards": (0.06, 12), "first_half_rushing_yards": (0.12, 7), "first_half_receiving_yards": (0.12, 7),
}


def softened(line: Column, market: Column) -> Column:
    """The line less its market's cushion, which is rounded to whole numbers; the line itself for others."""
    cushion = F.lit(0.0)
    for name, (share, most) in CUSHIONS.items():
        own = F.floor(line * share + 0.5).cast("double")
        cushion = F.when(market == name, own if most is None else F.least(own, F.lit(float(most)))).otherwise(cushion)
    return line - cushion


def hit_history(selections: DataFrame, logs: DataFrame, subject: str, at: str, season: str, value: str) -> DataFrame:
    """``selections`` (subject, at, season, market, side, line, implied) with rates at which the subject's
    earlier games of ``logs`` (subject, at, season, value) would have hit: over all of them, this season,
    the last season, the last five and ten, each against the line (``_hard``) and the softened one
    (``_soft``), and with the edge of both over the implied probability. NULL without such games.

    A subject's games are one array of a career's length, which its selections share; each looks
    through the part before it, so a selection and a game never become a row.
    """
    career = logs.filter(F.col(value).isNotNull()).groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(season).alias("season"), F.col(value).cast("double").alias("value")))).alias("_games"))
    met = selections.join(career, subject, "left").withColumn("_past", F.filter("_games", lambda g: g["at"] < F.col(at)))
    n = F.size("_past")
    last = lambda k: F.when(n > k, F.slice("_past", n - (k - 1), F.lit(k))).otherwise(F.col("_past"))
    spans = {"overall": F.col("_past"), "season": F.filter("_past", lambda g: g["season"] == F.col(season)), "last_season": F.filter("_past", lambda g: g["season"] == F.col(season) - 1), "last_5": last(5), "last_10": last(10)}
    met = met.withColumn("_soft", softened(F.col("line").cast("double"), F.col("market")))
    under = F.col("side").isin("UNDER", "NO")
    out = {}
    for name, span in spans.items():
        for kind, line in (("hard", F.col("line").cast("double")), ("soft", F.col("_soft"))):
            out[f"{name}_{kind}"] = F.try_divide(_hits(span, line, under).cast("double"), F.nullif(F.size(span), F.lit(0)))
    met = met.withColumns(out)
    edges = {f"{name}_edge_{kind}": F.col(f"{name}_{kind}") - F.col("implied") for name in spans for kind in ("hard", "soft")}
    return met.withColumns(edges).drop("_games", "_past", "_soft")


def _hits(span: Column, line: Column, under: Column) -> Column:
    return F.size(F.filter(span, lambda game: F.when(under, game["value"] < line).otherwise(game["value"] > line)))

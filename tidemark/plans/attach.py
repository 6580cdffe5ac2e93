"""Columns of other sources than the fact, attached to the cells of a view.

A source has a grain, and a cell its own; the pair, with a mode, decides by which rule they meet: on
shared keys, or through bridges that tell a cell its team or its opponent. Predicates of the attach
itself stand in the join, so cells without a partner stay; a filter on a source drops them, for all
columns of that source. Sources and bridges have one row for each of their keys, so nothing fans out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.model import Filter, filtered

GRAINS = {"player": ("player",), "player_year": ("player", "year"), "team": ("team",), "team_year": ("team", "year")}


@dataclass(eq=False)
class Source:
    """A table with one row for each value of its grain; ``keys`` names the column of each part."""

    name: str
    table: DataFrame
    grain: str
    keys: dict[str, str]
    #: Whether sorting by it first leaves only the subjects that it has rows for.
    leads: bool = False

    def __post_init__(self):
        if self.grain not in GRAINS:
            raise ValueError(f"unknown source grain {self.grain!r}")
        missing = [k for k in GRAINS[self.grain] if k not in self.keys]
        if missing:
            raise ValueError(f"source {self.name!r} of grain {self.grain!r} names no column for {missing}")


@dataclass(eq=False)
class Bridge:
    """A table that gives a cell's team, one row for each value of ``keys``."""

    table: DataFrame
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Attached:
    """A column of a source under a name of its own."""

    name: str
    source: str
    expr: str
    mode: str = "default"
    #: Part of the join: rows of the source that fail it are no partners, cells stay.
    within: tuple[Filter, ...] = ()
    #: Filters on the source's columns: cells without a partner that passes go.
    where: tuple[Filter, ...] = ()
    #: Years added to the cell's year when the source is looked up.
    year_offset: int = 0


@dataclass(frozen=True)
class Rule:
    bridges: tuple[str, ...] = ()
    #: The source's year is one that the column fixes, since the cell has none.
    fixed_year: bool = False


RULES: dict[tuple[str, str, str], Rule] = {}


def register_rule(cell: str, grain: str, rule: Rule, mode: str = "default") -> None:
    if (cell, grain, mode) in RULES:
        raise ValueError(f"a rule for {(cell, grain, mode)} is registered already")
    RULES[cell, grain, mode] = rule


for _cell in ("player", "team"):
    register_rule(_cell, f"{_cell}_year", Rule(fixed_year=True))
    for _axes in ("", "_year", "_year_week"):
        register_rule(_cell + _axes, _cell, Rule())
        if _axes:
            register_rule(_cell + _axes, f"{_cell}_year", Rule())
register_rule("player", "team", Rule(("current_team",)))
register_rule("player", "team_year", Rule(("current_team",), fixed_year=True))
for _axes in ("_year", "_year_week"):
    for _grain in ("team", "team_year"):
        register_rule("player" + _axes, _grain, Rule(("season_team",)))
for _grain in ("team", "team_year"):
    for _mode in ("opponent", "next_opponent"):
        register_rule("team_year_week", _grain, Rule((_mode,)), _mode)
        register_rule("player_year_week", _grain, Rule(("season_team", _mode)), _mode)


def rule_for(cell: str, source: Source, mode: str) -> Rule:
    """The rule of the mode, else the default one; a pair of grains without a rule is an error."""
    found = RULES.get((cell, source.grain, mode)) or RULES.get((cell, source.grain, "default"))
    if found is None:
        raise ValueError(f"source {source.name!r} of grain {source.grain!r} cannot be attached to {cell!r} cells")
    return found


def attach(view: DataFrame, cell: str, axes: tuple[str, ...], sources: dict[str, Source], bridges: dict[str, Bridge], columns: tuple[Attached, ...], leading: str | None) -> DataFrame:
    """The view with the attached columns; ``leading`` is the column it is sorted by first.

    Columns of one source, mode and scope share one join.
    """
    unknown = [c.source for c in columns if c.source not in sources]
    if unknown:
        raise ValueError(f"unknown sources {unknown}; there are {sorted(sources)}")
    strict = {c.source for c in columns if any(f.apply() is not None for f in c.where)}
    groups: dict[tuple, list[Attached]] = {}
    for c in columns:
        groups.setdefault((c.source, c.mode, c.within, c.where, c.year_offset), []).append(c)
    for at, ((name, mode, within, where, shift), members) in enumerate(groups.items()):
        source = sources[name]
        rule = rule_for(cell, source, mode)
        if rule.fixed_year and not any(f.column == source.keys["year"] and f.operator == "=" and f.value is not None for f in within):
            raise ValueError(f"{cell!r} cells take source {name!r} for one year: fix {source.keys['year']!r} within the attach")
        here = {"player" if cell.startswith("player") else "team": F.col("subject"), **{a: F.col(a) for a in axes}}
        for n, bridge in enumerate(rule.bridges):
            given, found = bridges[bridge], f"_to_{at}_{n}"
            asked = given.table.select(*[F.col(k).alias(f"_{k}_{at}_{n}") for k in given.keys], F.col("to_team").alias(found))
            on = [here[k] == F.col(f"_{k}_{at}_{n}") for k in given.keys]
            view = view.join(asked, on, "left").drop(*[f"_{k}_{at}_{n}" for k in given.keys])
            here["team"] = F.col(found)
        keys = [k for k in GRAINS[source.grain] if not (k == "year" and rule.fixed_year)]
        rows = filtered(filtered(source.table, within), where).select(*[F.col(source.keys[k]).alias(f"_{k}_{at}") for k in keys], *[F.expr(c.expr).alias(c.name) for c in members])
        on = [(here[k] + shift if k == "year" else here[k]) == F.col(f"_{k}_{at}") for k in keys]
        leads = source.leads and not rule.bridges and leading in [c.name for c in members]
        view = view.join(rows, on, "inner" if name in strict or leads else "left").drop(*[f"_{k}_{at}" for k in keys], *[f"_to_{at}_{n}" for n in range(len(rule.bridges))])
    return view

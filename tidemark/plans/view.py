"""From a view request to one DataFrame.

The spine (dimension by axes) is dense: subjects without facts keep a row of NULLs. Columns that
read the same facts share one aggregation; the signature of an aggregation is its resolved filters
and grain, so no parameter can be left out of it. Every aggregate is reduced to the cell's key
before it is joined, so nothing fans out. A rate's denominator sees the time scope but not the
column's own filters.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.plans.attach import attach
from tidemark.plans.model import COMPARE, NOT_ADDITIVE, PERIOD_OUTPUTS, Catalog, Filter, RateUnit, ViewColumn, ViewRequest, filtered

def output_names(request: ViewRequest) -> list[str]:
    """The measure's name and how often it was used before, as in ``revenue_0``, ``revenue_1``."""
    seen: dict[str, int] = {}
    names = []
    for column in request.columns:
        n = seen[column.measure] = seen.get(column.measure, -1) + 1
        names.append(f"{column.measure}_{n}")
    return names


def _facts(catalog: Catalog, request: ViewRequest, *more: str) -> DataFrame:
    """The fact with what the request reads of it; nothing is looked up that no column needs."""
    measures = [catalog.measures[c.measure] for c in request.columns]
    units = [catalog.units[c.output.unit] for c in request.columns if c.output.unit in catalog.units]
    named = [f.column for c in request.columns for f in c.filters if hasattr(f, "column")] + [k for c in request.columns for f in c.filters for p in getattr(f, "presets", ()) for k in p]
    return catalog.facts([catalog.subjects[request.grain], *units, *named, *(a.expr for m in measures for a in m.accumulators()), *more])


def _scoped(catalog: Catalog, request: ViewRequest, filters: tuple[Filter, ...], spread: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    facts = filtered(_facts(catalog, request, *more), filters)
    if request.years:
        facts = facts.filter(F.col("year").between(min(request.years) - spread, max(request.years) + spread)) if spread else facts.filter(F.col("year").isin(list(request.years)))
        facts = _dated(catalog, facts, min(request.years) - spread, max(request.years) + spread)
    return facts


def _dated(catalog: Catalog, facts: DataFrame, first: int, last: int) -> DataFrame:
    """Facts from one year to another, by a range of dates that the scan itself can use."""
    if catalog.dated is None:
        return facts
    kind = facts.schema[catalog.dated].dataType
    day = lambda year: F.lit(f"{year}-01-01").cast(kind)
    return facts.filter((F.col(catalog.dated) >= day(first)) & (F.col(catalog.dated) < day(last + 1)))


def _spine(catalog: Catalog, request: ViewRequest) -> DataFrame:
    table, key, attributes = catalog.dimensions[request.grain]
    spine = filtered(table, request.where).select(F.col(key).alias("subject"), *attributes)
    if "year" in request.axes:
        years = table.sparkSession.createDataFrame([(y,) for y in request.years], "year int")
        spine = spine.crossJoin(F.broadcast(years))  # one row for each year named in the request
    if "week" in request.axes:
        weeks = _scoped(catalog, request, ()).select("year", "week").distinct()
        spine = spine.join(weeks, "year")
    return spine


def _keys(request: ViewRequest) -> list[str]:
    return ["subject", *request.axes]


def _with_subject(catalog: Catalog, request: ViewRequest, facts: DataFrame) -> DataFrame:
    return facts.withColumn("subject", F.col(catalog.subjects[request.grain])).filter(F.col("subject").isNotNull())


def _career(catalog: Catalog, request: ViewRequest, years: tuple[int, int] | None, games: tuple[int, int] | None, facts: DataFrame) -> DataFrame:
    """Facts of the subject's first to last season or game so and so; ordinals come from all facts,
    one row for each subject and game, so no fact is ranked."""
    whole = _with_subject(catalog, request, _facts(catalog, request))
    if years:
        seasons = whole.select("subject", "year").distinct()
        place = F.row_number().over(Window.partitionBy("subject").orderBy("year"))
        facts = facts.join(seasons.withColumn("_n", place).filter(F.col("_n").between(*years)).drop("_n"), ["subject", "year"], "left_semi")
    if games:
        game = catalog.units["game"]
        played = whole.groupBy("subject", F.expr(game).alias("_game")).agg(F.min(F.struct("year", "week")).alias("_when"))
        place = F.row_number().over(Window.partitionBy("subject").orderBy("_when", "_game"))
        chosen = played.withColumn("_n", place).filter(F.col("_n").between(*games)).select("subject", "_game")
        facts = facts.withColumn("_game", F.expr(game)).join(chosen, ["subject", "_game"], "left_semi").drop("_game")
    return facts


REDUCTIONS = {"avg": F.avg, "min": F.min, "max": F.max, "latest": lambda c: F.max_by(c, "_from")}


def _offset_batch(catalog: Catalog, request: ViewRequest, facts: DataFrame, members: list[tuple[str, ViewColumn]], needed: dict) -> tuple[DataFrame, dict[str, F.Column]]:
    """Years are aggregated first and then moved to the rows that look back or ahead at them, so
    the join of years is an equi join on pre-aggregated rows."""
    if request.axes != ("year",) or any(a.kind in NOT_ADDITIVE for a in needed.values()):
        raise ValueError("a year offset needs the year axis alone and additive accumulators")
    (low, high), reduction = members[0][1].year_offset, members[0][1].offset_reduce
    yearly = facts.groupBy("subject", F.col("year").alias("_from")).agg(*[a.column().alias(n) for n, a in needed.items()])
    moved = yearly.withColumn("year", F.explode(F.sequence(F.col("_from") - high, F.col("_from") - low))).filter(F.col("year").isin(list(request.years)))
    cells = {name: catalog.measures[c.measure].combine() for name, c in members}
    if reduction == "pool":
        return moved.groupBy("subject", "year").agg(*[F.sum(n).alias(n) for n in needed]), cells
    reduced = [F.round(REDUCTIONS[reduction](cell), 8).alias(name) for name, cell in cells.items()]
    return moved.groupBy("subject", "year").agg(*reduced), {name: F.col(name) for name in cells}


def _total_batches(catalog: Catalog, request: ViewRequest) -> list[tuple[DataFrame, dict[str, F.Column], list[str]]]:
    """One aggregation for each distinct scope: its rows, the cells over them and its join keys."""
    groups: dict[tuple, list[tuple[str, ViewColumn]]] = {}
    for name, column in zip(output_names(request), request.columns):
        if column.output.kind in ("total", "rate"):
            groups.setdefault((*column.scope, column.cell_having), []).append((name, column))
    out = []
    for (filters, offset, _, years, games, pinned, bounds), members in groups.items():
        needed = {a.name: a for _, c in members for a in catalog.measures[c.measure].accumulators()}
        scoped = filtered(_dated(catalog, _facts(catalog, request).filter(F.col("year").isin(list(pinned))), min(pinned), max(pinned)), filters) if pinned else _scoped(catalog, request, filters, max(map(abs, offset)))
        facts = _career(catalog, request, years, games, _with_subject(catalog, request, scoped))
        # One pinned year repeats on each of the subject's rows; several follow the row's year.
        keys = [k for k in _keys(request) if k != "year"] if len(pinned) == 1 else _keys(request)
        if offset == (0, 0):
            batch = facts.groupBy(*keys).agg(*[a.column().alias(n) for n, a in needed.items()])
            out.append((batch, {name: catalog.measures[c.measure].combine() for name, c in members}, keys))
        else:
            out.append((*_offset_batch(catalog, request, facts, members, needed), keys))
        if bounds:
            batch, cells, own = out.pop()
            passing = all_of(*[COMPARE[op](cell, F.lit(bound)) for cell in cells.values() for op, bound in bounds])
            out.append((batch.filter(passing), cells, own))
    return out


def _rate_denominators(catalog: Catalog, request: ViewRequest) -> DataFrame | None:
    units = sorted({c.output.unit for c in request.columns if c.output.kind == "rate" and c.output.unit in catalog.units})
    if not units:
        return None
    facts = _with_subject(catalog, request, _scoped(catalog, request, ()))
    by_game = {"game", *catalog.parts_of_game, *catalog.around_game}
    if not set(units) <= by_game:
        return facts.groupBy(*_keys(request)).agg(*[F.countDistinct(F.expr(catalog.units[u])).alias(f"per_{u}") for u in units])
    # One row for each game first, with the few parts that it has: several distinct counts over the facts would
    # multiply every fact.
    counted = {u: F.size(F.collect_set(F.struct(F.expr(e)))).alias(u) for u, e in catalog.parts_of_game.items() if u in units}
    around = {u: F.any_value(F.expr(catalog.units[u])).alias(u) for u in catalog.around_game if u in units}
    games = facts.groupBy(*_keys(request), F.expr(catalog.units["game"]).alias("_game")).agg(F.max(F.expr(catalog.units["game"]).isNotNull().cast("int")).alias("game"), *counted.values(), *around.values())
    totals = [F.countDistinct(u) if u in around else F.sum(u) for u in units]
    return games.groupBy(*_keys(request)).agg(*[t.alias(f"per_{u}") for u, t in zip(units, totals)])


def _units_of(catalog: Catalog, request: ViewRequest, kind: str) -> dict[str, RateUnit]:
    names = {c.output.unit for c in request.columns if c.output.kind == "rate"}
    return {n: u for n, u in sorted(catalog.rate_units.items()) if n in names and u.kind == kind}


def _team_denominators(catalog: Catalog, request: ViewRequest) -> DataFrame | None:
    """Counts of a team's game are made once, and met by the games in which a subject has a fact."""
    units = _units_of(catalog, request, "team")
    if not units:
        return None
    team, game = catalog.teams[request.grain], list(catalog.meeting)
    facts = _scoped(catalog, request, (), more=(team, *(t for u in units.values() for t in u.texts()))).filter(F.col(team).isNotNull())
    counts = [(F.count(F.when(F.expr(u.where), 1)) if u.distinct is None else F.countDistinct(F.when(F.expr(u.where), F.expr(u.distinct)))).alias(f"per_{n}") for n, u in units.items()]
    games = facts.groupBy(F.col(team).alias("_team"), *game).agg(*counts)
    played = _with_subject(catalog, request, facts).select(*dict.fromkeys([*_keys(request), *game]), F.col(team).alias("_team")).distinct()
    return played.join(games, ["_team", *game]).groupBy(*_keys(request)).agg(*[F.sum(f"per_{n}").alias(f"per_{n}") for n in units])


def _role_denominators(catalog: Catalog, request: ViewRequest) -> DataFrame | None:
    """A fact counts for whoever stands in a role of the unit, whatever role the measure is of."""
    units = _units_of(catalog, request, "role")
    if not units:
        return None
    facts = _scoped(catalog, request, (), more=tuple(t for u in units.values() for t in u.texts()))
    held = [F.struct(F.lit(n).alias("unit"), F.when(F.expr(u.where) & F.expr(condition), F.col(column)).cast("long").alias("subject")) for n, u in units.items() for column, condition in u.roles]
    credits = facts.select(*request.axes, F.explode(F.filter(F.array(*held), lambda h: h["subject"].isNotNull())).alias("h")).select(*request.axes, "h.*")
    return credits.groupBy(*_keys(request)).agg(*[F.count(F.when(F.col("unit") == n, 1)).alias(f"per_{n}") for n in units])


def _field_denominators(catalog: Catalog, request: ViewRequest) -> DataFrame | None:
    """Facts of a game at which a subject takes part. A game's facts are one array, which is met by
    its members, so no fact becomes a row for each of them."""
    units, field = _units_of(catalog, request, "field"), catalog.on_field
    if not units:
        return None
    facts = _scoped(catalog, request, (), more=(field.game, field.member, *(t for u in units.values() for t in u.texts())))
    facts = facts.select(*request.axes, F.expr(field.game).alias("_game"), F.expr(field.member).alias("subject"), F.expr(field.place).alias("place"), *[F.expr(u.where).alias(n) for n, u in units.items()])
    own = [*request.axes, "_game"]
    games = facts.groupBy(*own).agg(F.collect_list(F.struct("place", *units)).alias("facts"))
    members = facts.filter("subject is not null").groupBy(*own, "subject").agg(F.min("place").alias("since"))

    def seen(unit: str) -> F.Column:
        return F.size(F.filter("facts", lambda fact: fact[unit] & (fact["place"] >= F.col("since"))))

    return members.join(games, own).select(*_keys(request), *[seen(n).alias(n) for n in units]).groupBy(*_keys(request)).agg(*[F.sum(n).alias(f"per_{n}") for n in units])


#: What makes the denominators of each kind of unit: a row for each cell with ``per_`` columns, or None.
DENOMINATORS: dict[str, Callable[[Catalog, ViewRequest], DataFrame | None]] = {"own": _rate_denominators, "team": _team_denominators, "role": _role_denominators, "field": _field_denominators}


def _period_batches(catalog: Catalog, request: ViewRequest) -> list[tuple[DataFrame, list[str]]]:
    """Counts and means: a value for each period first, then one row for each cell."""
    groups: dict[tuple, list[tuple[str, ViewColumn]]] = {}
    for name, column in zip(output_names(request), request.columns):
        if column.output.kind in PERIOD_OUTPUTS:
            groups.setdefault((column.filters, column.output.unit, column.career_years, column.career_games), []).append((name, column))
    out = []
    for (filters, unit, years, games), members in groups.items():
        needed = {a.name: a for _, c in members for a in catalog.measures[c.measure].accumulators()}
        facts = _career(catalog, request, years, games, _with_subject(catalog, request, _scoped(catalog, request, filters))).withColumn("period", F.expr(catalog.units[unit]))
        periods = facts.groupBy(*_keys(request), "period").agg(*[a.column().alias(n) for n, a in needed.items()])
        cells = [PERIOD_OUTPUTS[c.output.kind](catalog.measures[c.measure].combine(), c.output).alias(name) for name, c in members]
        out.append((periods.groupBy(*_keys(request)).agg(*cells), [n for n, _ in members]))
    return out


def check_request(catalog: Catalog, request: ViewRequest) -> None:
    """Says what a request names that the catalog does not know, before anything is planned."""
    if request.grain not in catalog.dimensions:
        raise ValueError(f"unknown grain {request.grain!r}; there are {sorted(catalog.dimensions)}")
    if request.axes not in ((), ("year",), ("year", "week")):
        raise ValueError(f"axes are year, or year and week, not {request.axes}")
    if request.axes and not request.years:
        raise ValueError("a view by year names its years")
    for column in request.columns:
        if column.measure not in catalog.measures:
            raise ValueError(f"unknown measure {column.measure!r}; there are {sorted(catalog.measures)}")
        known = catalog.units | (catalog.rate_units if column.output.kind == "rate" else {})
        if column.output.unit is not None and column.output.unit not in known:
            raise ValueError(f"unknown unit {column.output.unit!r}; there are {sorted(known)}")
        kind = catalog.rate_units[column.output.unit].kind if column.output.unit not in catalog.units and column.output.unit else None
        if kind == "team" and request.grain not in catalog.teams or kind == "field" and (catalog.on_field is None or catalog.subjects[request.grain] != catalog.on_field.member):
            raise ValueError(f"unit {column.output.unit!r} does not go with grain {request.grain!r}")
    named = [*output_names(request), *[c.name for c in request.attached], *[n for n, _ in request.computed]]
    fixed = [*_keys(request), *catalog.dimensions[request.grain][2]]
    twice = sorted({n for n in [*named, *fixed] if [*named, *fixed].count(n) > 1})
    if twice:
        raise ValueError(f"columns named more than once: {twice}")
    unknown = [c for c, _ in request.sort if c not in named + fixed]
    if unknown:
        raise ValueError(f"cannot sort by {unknown}: no such columns")


def plan_view(catalog: Catalog, request: ViewRequest) -> DataFrame:
    check_request(catalog, request)
    keys, names = _keys(request), output_names(request)
    view = _spine(catalog, request)
    for batch, cells, own in _total_batches(catalog, request):
        view = view.join(batch.select(*own, *[c.alias(n) for n, c in cells.items()]), own, "left")
    for denominators in (make(catalog, request) for make in DENOMINATORS.values()):
        if denominators is None:
            continue
        view = view.join(denominators, keys, "left")
        for name, column in zip(names, request.columns):
            if column.output.kind == "rate" and f"per_{column.output.unit}" in denominators.columns:
                view = view.withColumn(name, F.round(F.try_divide(F.col(name), F.nullif(F.col(f"per_{column.output.unit}"), F.lit(0))), 4))
    for batch, _ in _period_batches(catalog, request):
        view = view.join(batch, keys, "left")
    if request.attached:
        leading = request.sort[0][0] if request.sort else None
        view = attach(view, "_".join([request.grain, *request.axes]), request.axes, catalog.sources, catalog.bridges, request.attached, leading)
    for name, expression in request.computed:
        view = view.withColumn(name, F.expr(expression))
    view = filtered(view, request.having)
    attributes = catalog.dimensions[request.grain][2]
    view = view.select(*keys, *attributes, *names, *[c.name for c in request.attached], *[n for n, _ in request.computed])
    if request.with_count:
        # The number of rows is one aggregation beside the view; a window over all rows would put them in one task.
        view = view.crossJoin(F.broadcast(view.agg(F.count("*").alias("total_count"))))
    order = [(F.desc_nulls_last if down else F.asc_nulls_last)(c) for c, down in request.sort] + [F.asc(k) for k in keys]
    view = view.orderBy(*order)
    if request.offset:
        view = view.offset(request.offset)
    return view.limit(request.limit) if request.limit is not None else view


def all_of(*predicates: F.Column) -> F.Column:
    return reduce(operator.and_, predicates)


def option_counts(catalog: Catalog, filters: tuple[Filter, ...], options: dict[str, tuple[Filter, ...]]) -> DataFrame:
    """How many facts each preset would match under all other filters, in one pass."""
    named = [getattr(f, "column", "") for f in [*filters, *(f for preset in options.values() for f in preset)]]
    facts = filtered(catalog.facts(named), filters)
    counts = [F.count(F.when(all_of(*[f.apply() for f in preset]), 1)).alias(name) for name, preset in options.items()]
    wide = facts.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("option"), F.col(n).alias("n")) for n in options])).alias("o")).select("o.*")

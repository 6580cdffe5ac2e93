"""Declarations of a view: what is measured, over which facts, and how a cell is combined.

A measure is a set of additive accumulators and a combine step. Accumulators can be summed at any
grain, and the combine step comes last, so a ratio is never averaged or summed.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

if TYPE_CHECKING:
    from tidemark.plans.attach import Attached, Bridge, Source

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "count_distinct": F.countDistinct, "max": F.max}
#: Kinds whose values of several rows cannot be added up.
NOT_ADDITIVE = ("count_distinct", "max")


@dataclass(frozen=True)
class Accumulator:
    name: str
    kind: str
    expr: str

    def __post_init__(self):
        if self.kind not in AGGREGATES:
            raise ValueError(f"unknown accumulator kind {self.kind!r}")

    def column(self) -> Column:
        return AGGREGATES[self.kind](F.expr(self.expr))


@dataclass(frozen=True)
class Measure:
    """``numerator`` alone, or 100 or 1 times ``numerator / denominator``; NULL on zero."""

    name: str
    numerator: Accumulator
    denominator: Accumulator | None = None
    scale: float = 1.0
    digits: int = 4

    def accumulators(self) -> list[Accumulator]:
        return [a for a in (self.numerator, self.denominator) if a]

    def combine(self, prefix: str = "") -> Column:
        top = F.col(prefix + self.numerator.name).cast("double")
        if self.denominator is None:
            return top
        return F.round(F.try_divide(top * self.scale, F.col(prefix + self.denominator.name).cast("double")), self.digits)


@dataclass(frozen=True)
class Filter:
    """A predicate on a fact, dimension or finished column; an empty value is no filter."""

    column: str
    operator: str
    value: object = None

    def apply(self) -> Column | None:
        c, v = F.col(self.column), self.value
        if self.operator in ("IS NULL", "IS NOT NULL"):
            return c.isNull() if self.operator == "IS NULL" else c.isNotNull()
        if v is None or v == "" or (isinstance(v, (list, tuple)) and not v):
            return None
        simple = {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v} if not isinstance(v, (list, tuple)) else {}
        if self.operator in simple:
            return simple[self.operator]
        if self.operator in ("IN", "NOT IN"):
            return c.isin(list(v)) if self.operator == "IN" else ~c.isin(list(v))
        if self.operator == "BETWEEN":
            low, high = sorted(v)
            return c.between(low, high)
        if self.operator in ("LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE"):
            found = c.ilike(f"%{v}%") if "ILIKE" in self.operator else c.like(f"%{v}%")
            return ~found if self.operator.startswith("NOT") else found
        if self.operator == "OVERLAPS":  # an array column shares a value with the list
            return F.arrays_overlap(c, F.array(*[F.lit(x) for x in v]))
        if self.operator == "HAS":
            return F.array_contains(c, v)
        raise ValueError(f"unknown operator {self.operator!r}")


@dataclass(frozen=True)
class Presets:
    """One of several presets holds; a preset is a set of columns with the values they must have."""

    presets: tuple[dict[str, object], ...]

    def apply(self) -> Column | None:
        if not self.presets:
            return None
        each = [reduce(and_, [F.col(c) == v for c, v in preset.items()], F.lit(True)) for preset in self.presets]
        return reduce(or_, each)


def filtered(df: DataFrame, filters: tuple[Filter, ...] | list[Filter]) -> DataFrame:
    for one in filters:
        predicate = one.apply()
        if predicate is not None:
            df = df.filter(predicate)
    return df


COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "=": operator.eq, "<>": operator.ne}
#: What a cell makes of a measure's values by period, by the kind of the output.
PERIOD_OUTPUTS: dict[str, Callable[[Column, Output], Column]] = {}


def period_output(kind: str) -> Callable:
    """Registers an aggregate over a measure's values by period as a kind of output."""

    def add(make: Callable[[Column, Output], Column]) -> Callable[[Column, Output], Column]:
        if kind in PERIOD_OUTPUTS or kind in ("total", "rate"):
            raise ValueError(f"output {kind!r} is registered already")
        PERIOD_OUTPUTS[kind] = make
        return make

    return add


@period_output("mean")
def _mean(value: Column, output: Output) -> Column:
    return F.round(F.avg(value), 8)


@period_output("count")
def _count(value: Column, output: Output) -> Column:
    compare, bound = output.threshold
    return F.count(F.when(COMPARE[compare](value, F.lit(bound)), 1))


@period_output("most")
def _most(value: Column, output: Output) -> Column:
    return F.max(value)


@period_output("least")
def _least(value: Column, output: Output) -> Column:
    return F.min(value)


@dataclass(frozen=True)
class Output:
    """How a measure becomes a cell: as a total, as a rate, or from its values by period (count, mean,
    most, least, and whatever else is registered)."""

    kind: str = "total"
    unit: str | None = None  # the denominator unit of a rate, the period of count and mean
    threshold: tuple[str, float] | None = None

    def __post_init__(self):
        if self.kind not in ("total", "rate", *PERIOD_OUTPUTS):
            raise ValueError(f"unknown output {self.kind!r}")
        if (self.kind == "count") != (self.threshold is not None):
            raise ValueError("a count needs a threshold, and only a count takes one")
        if self.kind != "total" and not self.unit:
            raise ValueError(f"{self.kind} needs a unit")


@dataclass(frozen=True)
class ViewColumn:
    measure: str
    output: Output = Output()
    filters: tuple[Filter, ...] = ()
    #: Years relative to the row's year whose accumulators are pooled, both ends included.
    year_offset: tuple[int, int] = (0, 0)
    #: How the years of an offset become one value: pooled, or avg, min, max or latest of the years'.
    offset_reduce: str = "pool"
    #: Seasons or games of the subject's career, both ends included.
    career_years: tuple[int, int] | None = None
    career_games: tuple[int, int] | None = None
    #: Years of the facts of this column, whatever the row's year.
    pinned_years: tuple[int, ...] = ()
    #: Comparisons that the column's own cell must pass; a cell that fails one is empty.
    cell_having: tuple[tuple[str, float], ...] = ()

    def __post_init__(self):
        if self.offset_reduce not in ("pool", "avg", "min", "max", "latest"):
            raise ValueError(f"unknown reduction {self.offset_reduce!r}")
        if self.pinned_years and (self.output.kind != "total" or self.year_offset != (0, 0)):
            raise ValueError("a column with years of its own is a total without an offset")
        if self.cell_having and self.output.kind != "total":
            raise ValueError("only totals take comparisons of their own")

    @property
    def scope(self) -> tuple:
        """What decides which facts the column reads; columns of one scope share an aggregation."""
        return self.filters, self.year_offset, self.offset_reduce, self.career_years, self.career_games, self.pinned_years


@dataclass(frozen=True)
class ViewRequest:
    columns: tuple[ViewColumn, ...]
    grain: str = "player"
    axes: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    where: tuple[Filter, ...] = ()
    having: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()  # output column, descending
    offset: int = 0
    limit: int | None = 500
    #: Adds ``total_count``, the number of rows before the limit.
    with_count: bool = False
    #: Columns of other sources, by ``tidemark.plans.attach``.
    attached: tuple[Attached, ...] = ()
    #: Names and SQL expressions over finished columns, each over those before it.
    computed: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class RateUnit:
    """What a rate divides by, beyond the subject's own distinct units.

    ``team``: the facts of the subject's team in the games in which the subject has a fact itself.
    ``role``: the facts in which the subject stands in one of ``roles`` (column, condition).
    ``field``: the facts of its games at which the subject takes part (``Catalog.on_field``).
    Facts that fail ``where`` do not count; ``distinct`` is what is counted once for each game.
    """

    kind: str
    where: str = "true"
    distinct: str | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.kind not in ("team", "role", "field"):
            raise ValueError(f"unknown kind of unit {self.kind!r}")
        if bool(self.roles) != (self.kind == "role") or (self.distinct and self.kind != "team"):
            raise ValueError("roles belong to role units, and what is counted once to team units")

    def texts(self) -> list[str]:
        return [self.where, self.distinct or "", *(x for role in self.roles for x in role)]


@dataclass(frozen=True)
class OnField:
    """Who takes part in a fact: in each game (``game``) every ``member`` that stands in a fact of it,
    from the ``place`` of its first one on. A game is small: its facts are one array."""

    game: str
    member: str
    place: str


@dataclass
class Catalog:
    """A star schema: one fact table, a dimension for each grain, measures and rate units.

    ``units`` maps a unit to the fact expression whose distinct values are counted.
    """

    fact: DataFrame
    dimensions: dict[str, tuple[DataFrame, str, tuple[str, ...]]]  # grain: table, key, attributes
    subjects: dict[str, str]  # grain: subject column of the fact
    measures: dict[str, Measure] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    #: Units that lie within a game, by the expression that tells them apart there.
    parts_of_game: dict[str, str] = field(default_factory=dict)
    #: Units that a game lies in as a whole.
    around_game: tuple[str, ...] = ()
    #: Which facts count at all; those for which it is null do not. A filter of each view.
    live: str | None = None
    #: The fact's date column, by which years are cut out in the scan.
    dated: str | None = None
    #: Columns that a fact gets only where a request names them: the table, its key, and the fact's.
    lookups: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    rate_units: dict[str, RateUnit] = field(default_factory=dict)
    #: Of each grain, the fact column of the subject's team; and the game in which teams meet.
    teams: dict[str, str] = field(default_factory=dict)
    meeting: tuple[str, ...] = ("year", "week")
    on_field: OnField | None = None
    sources: dict[str, Source] = field(default_factory=dict)
    bridges: dict[str, Bridge] = field(default_factory=dict)

    def facts(self, texts: list[str]) -> DataFrame:
        """The fact with the looked-up columns that any of the expressions mentions."""
        out = self.fact if self.live is None else self.fact.filter(F.expr(self.live))
        for column, (table, key, own) in self.lookups.items():
            if any(column in text for text in texts):
                out = out.join(table.select(F.col(key).alias("_key"), F.col(column)), F.col(own) == F.col("_key"), "left").drop("_key")
        return out

    def register(self, measure: Measure) -> None:
        if measure.name in self.measures:
            raise ValueError(f"measure {measure.name!r} is registered already")
        self.measures[measure.name] = measure

    def attachable(self, source: Source) -> None:
        if source.name in self.sources:
            raise ValueError(f"source {source.name!r} is registered already")
        self.sources[source.name] = source

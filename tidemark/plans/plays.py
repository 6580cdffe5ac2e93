"""The plays view: filtered facts as they are, or grouped, with a cap on what is returned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.model import Filter, filtered

#: A view returns at most so many plays; it is the feature, not a bound on what is read.
MOST_PLAYS = 2000


@dataclass(frozen=True)
class PlaysRequest:
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    having: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    limit: int = 500


def plan_plays(plays: DataFrame, request: PlaysRequest, tie: tuple[str, ...], aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Rows of plays, or one for each group with ``aggregates``; sorted, NULLs last, ties by ``tie``
    (the group's keys when grouped). Sort and limit are one top-k: no full sort of the facts."""
    rows = filtered(plays, request.filters)
    if request.group_by:
        rows = filtered(rows.groupBy(*request.group_by).agg(*[c.alias(n) for n, c in (aggregates or {}).items()]), request.having)
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in request.sort]
    rows = rows.orderBy(*order, *[F.asc(c) for c in (request.group_by or tie)]).limit(min(request.limit, MOST_PLAYS))
    return rows if request.group_by else rows.select(*request.columns)

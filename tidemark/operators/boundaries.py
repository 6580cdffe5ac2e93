"""Moments at which values are asked for, and what is done where none is known there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.joins import asof_join
from tidemark.operators.ordered import join_by
from tidemark.storage import Workspace


def moment_of_year(year: Column, month: int, day: int, offset: int = 0, now: Column | None = None) -> Column:
    """That day of the year ``offset`` years on; a day that the month lacks goes on into the next one.
    Not later than ``now``, where that is given."""
    moment = F.date_add(F.make_date(year + offset, F.lit(month), F.lit(1)), day - 1)
    return moment if now is None else F.least(moment, now.cast("date"))


def moment_of_opening(opening: Column, offset: int = 0, now: Column | None = None) -> Column:
    """A season's opening day moved by whole years, not later than ``now``."""
    moment = F.add_months(opening, 12 * offset)
    return moment if now is None else F.least(moment, now.cast("date"))


def same_day(moment: Column, year: Column) -> Column:
    """The month and day of ``moment`` in another year; 29 February is 1 March where there is none."""
    return F.date_add(F.make_date(year, F.month(moment), F.lit(1)), F.dayofmonth(moment) - 1)


def asof_or_analog(asked: DataFrame, series: DataFrame, own: str, year: str, kind: list[str], at: str, observed: str, value: str) -> DataFrame:
    """``asked`` with ``value`` and ``known``: the value last observed at ``at`` in the series of its
    ``year`` and ``kind`` (``exact``), else one of another year (``analog``), else NULL.

    An analog is a series of the same kind whose year is as many years away from the same day in
    another calendar year, and which has observations on both sides of that day (or on it); of several
    the one whose window holds the day most centrally, ties to the earlier year. ``own`` is a column of
    ``asked``; dates are days. Each day of a year and kind is looked up once, however many rows ask for
    it, and the rows meet what was found: those days are few, so ``asked`` is as a rule not shuffled.
    Only days without an exact value meet the windows, which are a row for each year and kind, and each
    of them is looked up in one analog.
    """
    moment, space = [year, *kind, at], Workspace(asked.sparkSession, "analog")
    series = space.save(series.select(year, *kind, observed, value), "series")
    days = space.save(asked.select(*moment).distinct(), "days")
    exact = space.save(asof_join(days, series, [year, *kind], at, observed, [value]).drop(f"asof_{observed}"), "exact")
    windows = series.groupBy(F.col(year).alias("_year"), *kind).agg(F.min(observed).alias("_first"), F.max(observed).alias("_last"))
    missing = exact.filter(F.col(f"asof_{value}").isNull()).select(*moment)
    away = F.col(year) - F.year(at)
    met = missing.withColumn("_own", F.col(year)).join(windows, kind).withColumn("_day", same_day(F.col(at), F.col("_year") - away)).filter(F.col("_day").between(F.col("_first"), F.col("_last")))
    central = F.least(F.date_diff("_day", "_first"), F.date_diff("_last", "_day"))
    best = met.groupBy("_own", *kind, at).agg(F.max(F.struct(central.alias("central"), (-F.col("_year")).alias("back"), "_day")).alias("b")).select("_own", *kind, at, (-F.col("b.back")).alias(year), F.col("b._day").alias("_day"))
    analog = asof_join(best, series, [year, *kind], "_day", observed, [value]).select(F.col("_own").alias(year), *kind, at, F.col(f"asof_{value}").alias("_analog"))
    known = F.when(F.col(f"asof_{value}").isNotNull(), "exact").when(F.col("_analog").isNotNull(), "analog")
    found = join_by(exact, analog, moment, "left").select(*moment, F.coalesce(f"asof_{value}", "_analog").alias(value), known.alias("known"))
    found = space.save(found, "found")
    space.drop("series", "days", "exact")
    return join_by(asked, found, moment, "left").select(*asked.columns, value, "known")

"""Parameters that depend on the day: resolved to years and weeks before a view is planned."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Clock:
    """The season as it stands; injected, so that a request gives the same plan on each run."""

    year: int
    week: int
    last_week: int = 18
    first_year: int = 2000


def resolve(clock: Clock, kind: str, n: int = 1) -> tuple[int, ...]:
    """Years, or weeks of the season, that a dynamic value stands for. Weeks end with the season."""
    years = {
        "current_year": lambda: range(clock.year, clock.year + 1),
        "last_n_years": lambda: range(max(clock.first_year, clock.year - n + 1), clock.year + 1),
        "next_n_years": lambda: range(clock.year, clock.year + n),
    }
    weeks = {
        "current_week": lambda: range(clock.week, clock.week + 1),
        "last_n_weeks": lambda: range(max(1, clock.week - n + 1), clock.week + 1),
        "next_n_weeks": lambda: range(clock.week, min(clock.last_week, clock.week + n - 1) + 1),
        "current_year_weeks": lambda: range(1, clock.last_week + 1),
    }
    found = (years | weeks).get(kind)
    if found is None:
        raise ValueError(f"unknown dynamic value {kind!r}")
    if n < 1:
        raise ValueError("a dynamic value spans one year or week at least")
    return tuple(found())

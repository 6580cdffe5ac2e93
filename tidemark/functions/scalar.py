"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds > 0, 1 + odds / 100).when(odds < 0, 1 - 100 / odds)


def implied_probability(decimal_odds: Column) -> Column:
    return F.try_divide(F.lit(1.0), decimal_odds)


def settle_over_under(result: Column, line: Column, over: Column) -> Column:
    """WON, LOST or PUSH; NULL while a side is missing."""
    won = F.when(over, result > line).otherwise(result < line)
    return F.when(result.isNull() | line.isNull(), None).when(result == line, "PUSH").when(won, "WON").otherwise("LOST")


def ngrams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams of a text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))


def body_mass_index(weight: Column, height: Column) -> Column:
    exact, height = weight.cast("decimal(18,4)"), height.cast("decimal(8,2)")  # decimals, so that halves round up
    return F.when(height > 0, F.round(exact * 703 / (height * height), 2)).cast("double")


def plain_speed_score(weight: Column, forty: Column) -> Column:
    """Weight over the fourth power of the dash time, whatever the position."""
    exact, forty = weight.cast("decimal(18,4)"), forty.cast("decimal(6,2)")
    return F.when(forty > 0, F.round(exact * 200 / (forty * forty * forty * forty), 2)).cast("double")


def sum_of_known(*parts: Column) -> Column:
    """Missing parts count 0, as in agility and burst scores."""
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


def age_years(at: Column, born: Column) -> Column:
    """Whole years, months by twelfths, the days left over by 365.25ths; two digits."""
    at, born = at.cast("date"), born.cast("date")
    months = (F.year(at) - F.year(born)) * 12 + F.month(at) - F.month(born)
    days = F.dayofmonth(at) - F.dayofmonth(born)
    short = days < 0  # a month is borrowed, with as many days as the month of birth has
    months, days = months - short.cast("int"), days + F.when(short, F.dayofmonth(F.last_day(born))).otherwise(0)
    return F.round(months / 12 + days / 365.25, 2)


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``MM:SS``; 0 where it can't be read."""
    minutes, seconds = (F.regexp_extract(F.trim(clock), r"^(\d+):(\d+)$", k).try_cast("int") for k in (1, 2))
    return F.coalesce(minutes * 60 + seconds, F.lit(0))


def game_progress(quarter: Column, clock: Column, final: Column) -> Column:
    """Share of four quarters of 900 seconds that is over, within [0, 1]; overtime is 1."""
    elapsed = ((quarter - 1) * 900 + 900 - clock_seconds(clock)) / 3600
    return F.when(final, 1.0).when(quarter.isNull() | (quarter < 1), 0.0).when(quarter >= 5, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), elapsed)))


def live_projection(so_far: Column, projection: Column, progress: Column) -> Column:
    return F.coalesce(so_far, F.lit(0)) + F.coalesce(projection, F.lit(0)) * (1 - progress)


def personnel_counts(text: Column) -> Column:
    """``1 RB, 2 TE`` as a map of position to count."""
    counts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+) ([A-Z]+)"), F.lit(1)), lambda n: n.cast("int"))
    return F.map_from_arrays(F.regexp_extract_all(text, F.lit(r"(\d+) ([A-Z]+)"), F.lit(2)), counts)


def similar_names(a: Column, b: Column) -> Column:
    """Equal, one inside the other, an edit ratio of at most 0.3 or a bigram distance of at most 0.4."""
    a, b = F.lower(a), F.lower(b)
    return (a == b) | F.contains(a, b) | F.contains(b, a) | (levenshtein_ratio(a, b) <= 0.3) | (1 - jaccard(ngrams(a), ngrams(b)) <= 0.4)


def name_matches(text: Column, query: str) -> Column:
    """Every word of ``query`` is a word of the text, letter case aside."""
    words = F.split(F.lower(text), r"\W+")
    found = F.lit(True)
    for word in query.lower().split():
        found = found & F.array_contains(words, word)
    return found


def rank_band(place: Column, pool: Column, bands: int) -> Column:
    """Band of a row number in its pool, from 0."""
    return F.floor((place - 1) * bands / pool).cast("int")


def share_percent(part: Column, whole: Column, most: float = 999.99) -> Column:
    return F.least(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(most))


def month_day(year: Column, month: int, day: int) -> Column:
    """That day of the year, or the month's last one where it has fewer."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def speed_score(weight: Column, seconds: Column, height: Column, position: Column) -> Column:
    """Weight over the fourth power of the dash time, by height against the norm of the position; NULL
    for other positions than WR and TE and without a time."""
    score = F.try_divide(weight * 200.0, F.nullif(F.pow(seconds, F.lit(4)), F.lit(0.0))) * (height / F.when(position == "TE", 76.4).otherwise(73.0))
    return F.when(position.isin("WR", "TE") & (seconds > 0), F.round(score, 2))


def extended_salary(salary: Column, slot: Column, tag: Column, position: Column, extensions: Column, tag_prices: dict[str, Column], practice: tuple[str, ...] = ("PS",), step: int = 5) -> Column:
    """What a player costs next season: the salary itself on practice slots and under a rookie tag, the
    position's price under a franchise tag, else a step more for this extension and each before it."""
    own = F.coalesce(salary, F.lit(0))
    franchise = F.coalesce(*[F.when(position == p, F.coalesce(price, F.lit(0))) for p, price in tag_prices.items()], F.lit(0))
    rising = own + (F.coalesce(extensions, F.lit(0)) + 1) * step
    return F.when(slot.isin(*practice), own).when(tag == "franchise", franchise).when(tag == "rookie", own).otherwise(rising)


def masked(value: Column, owner: Column, viewer: int | None, announced: Column, cover: str) -> Column:
    """A private value for its owner and once it is announced; ``cover`` for other viewers."""
    seen = announced if viewer is None else announced | (owner == viewer)
    return F.when(value.isNull() | F.coalesce(seen, F.lit(False)), value).otherwise(cover)

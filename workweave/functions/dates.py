"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("int")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter Sunday, by Lichtenberg's form of the Gauss rule."""
    century = _div(year, 100)
    skipped_leaps = _div(century * 3 + 3, 4)
    moon_shift = skipped_leaps + 15 - _div(century * 8 + 13, 25)
    golden = year % 19
    moon = (golden * 19 + moon_shift) % 30
    full_moon = moon + 21 - _div(moon + _div(golden, 11), 29)
    first_sunday = F.lit(7) - (year + _div(year, 4) + 2 - skipped_leaps) % 7
    to_sunday = F.lit(7) - (full_moon - first_sunday) % 7
    march_first = F.make_date(year, F.lit(3), F.lit(1))
    return F.date_add(march_first, (full_moon + to_sunday - 1).cast("int"))


def wednesday_before_nov_23(year: Column) -> Column:
    """The last Wednesday not later than 22 November."""
    last = F.make_date(year, F.lit(11), F.lit(22))
    return F.date_sub(last, ((F.weekday(last) + 5) % 7).cast("int"))


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def days_between(start: Column, end: Column) -> Column:
    """Calendar days of an inclusive interval."""
    return F.datediff(end, start) + 1


def half_day_round(x: Column) -> Column:
    """Round to half days, ties upwards (also below zero)."""
    return F.floor(x * 2 + 0.5) / 2


def german_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def german_number(x: Column) -> Column:
    """``10`` or ``10,5``: no decimals when whole, comma otherwise."""
    whole = x == F.floor(x)
    return F.when(whole, F.floor(x).cast("string")).otherwise(
        F.regexp_replace(x.cast("string"), r"\.", ",")
    )


def german_range(start: Column, end: Column) -> Column:
    """Compact text of an interval: shared month and year are written once."""
    same_year = F.year(start) == F.year(end)
    same_month = same_year & (F.month(start) == F.month(end))
    return (
        F.when(start == end, german_date(end))
        .when(same_month, F.concat(F.date_format(start, "dd."), F.lit("–"), german_date(end)))
        .when(same_year, F.concat(F.date_format(start, "dd.MM."), F.lit(" – "), german_date(end)))
        .otherwise(F.concat(german_date(start), F.lit(" – "), german_date(end)))
    )


def iso(day: Column) -> Column:
    return day.cast("string")

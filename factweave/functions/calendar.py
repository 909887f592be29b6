"""Market calendar as pure expressions: no join, no lookup table, any year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def _nth(year: Column, month: int, day: str, n: int) -> Column:
    """The n-th such weekday of a month."""
    return F.date_add(F.next_day(F.date_sub(_day(year, month, 1), 1), day), 7 * (n - 1))


def _last(year: Column, month: int, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(_day(year, month, 1)), 7), day)


def _observed(day: Column) -> Column:
    """Saturday is kept on Friday, Sunday on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday."""
    div = lambda a, b: F.floor(a / b).cast("int")
    golden, century = year % 19, div(year, 100)
    skipped, drift = century - div(century, 4), div(8 * century + 13, 25)
    epact = (skipped - drift + 19 * golden + 15) % 30
    full = epact - div(epact, 28) * (1 - div(F.lit(29), epact + 1) * div(21 - golden, 11))
    weekday = (year + div(year, 4) + full + 2 - skipped) % 7
    return F.date_add(_day(year, 3, 28), (full - weekday).cast("int"))


def holidays(year: Column) -> Column:
    """The market's closing days of a year."""
    fixed = [_observed(_day(year, m, d)) for m, d in ((1, 1), (7, 4), (12, 25))]
    juneteenth = F.when(year >= 2022, _observed(_day(year, 6, 19)))
    moving = [_nth(year, 1, "Mon", 3), _nth(year, 2, "Mon", 3), F.date_sub(easter(year), 2), _last(year, 5, "Mon"), _nth(year, 9, "Mon", 1), _nth(year, 11, "Thu", 4)]
    return F.array_compact(F.array(*fixed, juneteenth, *moving))


def _near_holidays(day: Column) -> Column:
    return F.flatten(F.array(*(holidays(F.year(day) + k) for k in (-1, 0, 1))))


def is_business_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~F.array_contains(_near_holidays(day), day)


def _first_open(day: Column, step: int) -> Column:
    """The first business day from ``day`` on in steps of a day; no closing lasts ten days."""
    days = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.date_add(day, k * step))
    return F.get(F.array_except(F.filter(days, lambda d: F.weekday(d) < 5), _near_holidays(day)), 0)


def previous_business_day(day: Column) -> Column:
    """The day itself or the last business day before it."""
    return _first_open(day, -1)


def next_business_day(day: Column) -> Column:
    """The day itself or the first business day after it."""
    return _first_open(day, 1)


def due_date(form: Column, filed: Column, fiscal_period: Column) -> Column:
    """A year on for 10-K, three months for 10-Q and six after Q3; another form ends the job, none gives NULL."""
    form = F.upper(form)
    known = F.when(form.isNull() | form.isin("10-K", "10-Q"), form).otherwise(F.raise_error(F.concat(F.lit("no refresh rule for form "), form)))
    form = known
    return F.when(form == "10-K", F.add_months(filed, 12)).when((form == "10-Q") & (F.upper(F.coalesce(fiscal_period, F.lit(""))) == "Q3"), F.add_months(filed, 6)).when(form == "10-Q", F.add_months(filed, 3))


def next_check_date(form: Column, filed: Column, fiscal_period: Column) -> Column:
    """When to look for the next filing: the business day at or before it is due."""
    return previous_business_day(due_date(form, filed, fiscal_period))


def attach_business_day(df: DataFrame, day: str, out: str, *, later: bool = False) -> DataFrame:
    """``df`` with the business day at or before (or after) ``day``, worked out once for each distinct day.

    The days of a calendar are bounded (3.7 million up to the year 9999), so they are joined by broadcast.
    """
    rule = next_business_day if later else previous_business_day
    days = df.select(F.col(day).alias("_day")).filter("_day is not null").distinct()
    days = days.select("_day", rule(F.col("_day")).alias(out))
    return df.join(F.broadcast(days), F.col(day) == F.col("_day"), "left").drop("_day")


def retry_check_date(as_of: Column) -> Column:
    """Nothing new was there: look again on the business day after tomorrow."""
    return next_business_day(F.date_add(as_of, 1))

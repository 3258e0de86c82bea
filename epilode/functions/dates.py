"""Epidemiological weeks, feed dates, date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(date: Column) -> Column:
    """Sunday that opens the epidemiological week of `date`."""
    return F.date_sub(date, F.dayofweek(date) - 1)


def week_end(date: Column) -> Column:
    """Saturday that closes the epidemiological week of `date`."""
    return F.date_add(week_start(date), 6)


def _midweek(date: Column) -> Column:
    # A week belongs to the year holding at least four of its days, which is
    # the year of its Wednesday.
    return F.date_add(week_start(date), 3)


def week_year(date: Column) -> Column:
    return F.year(_midweek(date))


def week_number(date: Column) -> Column:
    return (F.floor((F.dayofyear(_midweek(date)) - 1) / 7) + 1).cast("int")


def feed_date(date: Column | None = None, days_ago: int | None = None) -> Column:
    """`ddMMMyyyy` text used by the feed's query strings.

    An explicit date wins, then `days_ago` before today, then today.
    """
    if date is None:
        date = F.date_sub(F.current_date(), days_ago) if days_ago is not None else F.current_date()
    return F.date_format(date.cast("date"), "ddMMMyyyy")


def parse_report_datetime(text: Column) -> Column:
    """`M/d/yyyy h:mm a`, else `M/d/yyyy`; anything else is NULL.

    The parts are put together without a time zone: a local time that a zone's clock
    change leaves out is still that time.
    """
    parts = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{2}) ([AP])M)?$"
    upper = F.upper(F.btrim(text))

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(upper, parts, i), F.lit("")).try_cast("int")

    hour, half = part(4), F.regexp_extract(upper, parts, 6)
    hour_of_day = F.when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    return F.when(
        half == "", F.try_make_timestamp_ntz(part(3), part(1), part(2), F.lit(0), F.lit(0), F.lit(0))
    ).otherwise(F.try_make_timestamp_ntz(part(3), part(1), part(2), hour_of_day, part(5), F.lit(0)))


def daily_grid(first: Column, last: Column) -> Column:
    """One row per day from `first` to `last` (a generator expression)."""
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))

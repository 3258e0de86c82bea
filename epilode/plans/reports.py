"""Case reports and the weekly count report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.functions.dates import parse_report_datetime, week_end, week_number, week_start, week_year
from epilode.functions.measures import suppress_count
from epilode.functions.text import correct_town
from epilode.operators.aggregates import add_share
from epilode.operators.columns import across_contains, drop_position, strip_headers
from epilode.session import cut_lineage


def clean_report(report: DataFrame, formatted: bool = True, exact_tokens: bool = False) -> DataFrame:
    """Plain headers, typed dates, corrected towns; a formatted report loses column 2."""
    out = strip_headers(report)
    out = across_contains(out, "Date", parse_report_datetime, exact_tokens)
    out = across_contains(out, "City", correct_town, exact_tokens)
    return drop_position(out, 2) if formatted else out


def weekly_report(events: DataFrame, date: str, condition: str, threshold: int = 5) -> DataFrame:
    """Counts per epidemiological week and condition, share of the week, small counts hidden."""
    day = F.to_date(date)
    # Count per day first: week arithmetic then runs on the few day rows.
    daily = events.groupBy(day.alias("day"), condition).agg(F.count(F.lit(1)).alias("n"))
    counts = daily.groupBy(
        week_start(F.col("day")).alias("week_start"), condition
    ).agg(F.sum("n").alias("n"))
    # The events are read once; totals and shares come from the written counts.
    counts = cut_lineage(counts, "weekly_counts")
    return add_share(counts, "n", ["week_start"]).select(
        "week_start",
        week_end(F.col("week_start")).alias("week_end"),
        week_year(F.col("week_start")).alias("week_year"),
        week_number(F.col("week_start")).alias("week"),
        condition,
        "n",
        "proportion",
        suppress_count(F.col("n"), threshold).alias("n_shown"),
    )

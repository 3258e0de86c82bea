"""Counts, rates, bands, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epilode.functions.nulls import ratio

# Age bands in display order.
AGE_BANDS = ["< 20", "20s", "30s", "40s", "50s", "60s", "70s", "> 80"]

SQFT_PER_SQMI = 27_878_400.0
SQM_PER_SQMI = 2_589_988.110336


def suppress_count(count: Column, censor_threshold: int = 5) -> Column:
    """Hide small counts: strictly between 0 and the threshold becomes NULL."""
    return F.when((count > 0) & (count < censor_threshold), F.lit(None)).otherwise(count)


def rate(num: Column, pop: Column, per: float, decimals: int = 0) -> Column:
    """num per `per` of pop, halves rounded to even; NULL when pop is zero."""
    return F.bround(ratio(num, pop) * F.lit(per), decimals)


def age_band(age: Column) -> Column:
    """Decade label.  80 and 79.5 fall in the top band, 19.5 in the bottom one."""
    return (
        F.when(age < 20, F.lit(AGE_BANDS[0]))
        .when(age > 79, F.lit(AGE_BANDS[-1]))
        .when((age < 80) & (age > 19), F.concat(F.substring(age.cast("string"), 1, 1), F.lit("0s")))
    )


def age_band_order(band: Column) -> Column:
    """1-based position of a band label in display order."""
    return F.nullif(F.array_position(F.array(*[F.lit(b) for b in AGE_BANDS]), band), F.lit(0)).cast("int")


def interval_start(label: Column) -> Column:
    """Lower bound of `[a,b)` or `(a,b]`, rounded to one decimal."""
    return F.bround(F.regexp_extract(label, r"^[\[(](.+),.*", 1).try_cast("double"), 1)


def number_text(x: Column) -> Column:
    """Number as display text: `10`, `9.9`."""
    one = F.bround(x, 1)
    return F.when(one == F.floor(one), F.floor(one).cast("string")).otherwise(one.cast("string"))


def interval_label(start: Column, next_start: Column) -> Column:
    """`a - b` up to just under the next start; the last level has no next."""
    return F.when(
        next_start.isNotNull(),
        F.concat(number_text(start), F.lit(" - "), number_text(next_start - 0.1)),
    ).otherwise(F.concat(F.lit("More than "), number_text(start)))


def normalize_flow(copies: Column, flow_mean: Column, marker_mean: Column, marker: Column) -> Column:
    """Concentration scaled by mean flow and by the marker's usual level."""
    return copies * flow_mean * ratio(marker_mean, marker)


def area_sqmi(area: Column, source_unit: str = "ft2") -> Column:
    """Area in square miles; `source_unit` is `ft2` or `m2`."""
    per = {"ft2": SQFT_PER_SQMI, "m2": SQM_PER_SQMI}[source_unit]
    return area / F.lit(per)

"""Feed codes, census labels, request URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V


def race_ethnicity(race_flat: Column, ethnicity_flat: Column) -> Column:
    """One race/ethnicity label per visit; missing input is `Unknown`."""
    race = F.regexp_replace(race_flat, V.RACE_NOISE, "")
    chain = F.when(F.contains(ethnicity_flat, F.lit(V.HISPANIC_CODE)), F.lit(V.HISPANIC_LABEL))
    chain = reduce(lambda c, rl: c.when(race == rl[0], F.lit(rl[1])), V.RACE_LABELS, chain)
    return chain.when(race.rlike(";.*;.*;"), F.lit(V.MULTIPLE_LABEL)).otherwise(F.lit(V.UNKNOWN_LABEL))


def label_sex(label: Column) -> Column:
    """`Male` or `Female` from a variable label, else `Total`."""
    return F.coalesce(F.nullif(F.regexp_extract(label, "(Male|Female)", 1), F.lit("")), F.lit("Total"))


def label_age(label: Column) -> Column:
    """Text after the last `!!`; a bare total or sex is `Total`."""
    last = F.regexp_replace(label, "^.*!!", "")
    return F.when(last.isin("Total", "Male", "Female"), F.lit("Total")).otherwise(last)


def set_feed_window(url: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Replace the date window of a feed URL.

    A parameter is only replaced when `&` follows it, so the last one stays.
    """
    if end is not None:
        url = F.regexp_replace(url, F.lit("endDate=.*?&"), F.concat(F.lit("endDate="), end, F.lit("&")))
    if start is not None:
        url = F.regexp_replace(url, F.lit("startDate=.*?&"), F.concat(F.lit("startDate="), start, F.lit("&")))
    return url


PARTIAL_ZCTA = "Partial ZCTA populations are not available."


def census_url(base: Column, geo_type: Column, place: Column, variable: Column,
               group: Column, in_county: Column) -> tuple[Column, Column]:
    """(request URL, error) for a small-area estimate; the key is never part of it."""
    wanted = F.when(group, F.concat(F.lit("group("), variable, F.lit(")"))).otherwise(variable)
    clause = (
        F.when((geo_type == "muni") & in_county, F.concat(F.lit(V.CLAUSE_PLACE_IN_COUNTY), place))
        .when((geo_type == "muni") & ~in_county,
              F.concat(F.lit(V.CLAUSE_PLACE), place, F.lit(V.CLAUSE_PLACE_STATE)))
        .when((geo_type == "zcta") & ~in_county, F.concat(F.lit(V.CLAUSE_ZCTA), place))
    )
    error = F.when((geo_type == "zcta") & in_county, F.lit(PARTIAL_ZCTA))
    url = F.concat(base, F.lit("?get=NAME,GEO_ID,"), wanted, clause)
    return F.when(error.isNull(), url), error


def geocode_url(service: Column, street: Column, city: Column, zip_code: Column,
                wkid: int = V.STATE_PLANE) -> Column:
    """Single-address request from separate fields; blanks become `+`."""
    url = F.concat(service, F.lit("?Address="), street, F.lit("&City="), city, F.lit("&Postal="), zip_code,
                   F.lit(f"&outSR={wkid}{V.GEOCODE_OPTIONS}"))
    return F.replace(url, F.lit(" "), F.lit("+"))


def geocode_url_one_line(service: Column, address: Column, wkid: int = V.STATE_PLANE) -> Column:
    """Single-address request from one field; blanks stay."""
    return F.concat(service, F.lit("?Street=&City=&SingleLine="), address,
                    F.lit(f"&outSR={wkid}{V.GEOCODE_OPTIONS_ONE_LINE}"))

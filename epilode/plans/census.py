"""Census responses to tables; estimates of a jurisdiction by subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V
from epilode.functions.codes import label_age, label_sex
from epilode.functions.text import split_last
from epilode.operators.aggregates import to_wide
from epilode.operators.columns import keep_estimates
from epilode.operators.joins import left_lookup
from epilode.sources.feeds import matrix_rows


def estimates_table(landed: DataFrame, payload: str, place_code: str, labels: DataFrame) -> DataFrame:
    """All landed responses at once: estimate, margin and label per place and variable.

    labels(name, label, concept) is the variable list.
    """
    ids = ["place_code", "NAME"]
    long = matrix_rows(landed.withColumnRenamed(place_code, "place_code"), payload, ["place_code"], ["NAME", "GEO_ID"])
    stem, kind = split_last(F.col("variable"))
    parts = keep_estimates(long, "variable").withColumns({"stem": stem, "kind": kind})
    wide = to_wide(parts, [*ids, "stem"], "kind", "value", {"E": "estimate", "M": "moe"})
    named = wide.withColumn("variable", F.concat("stem", F.lit("E"))).drop("stem")
    return left_lookup(named, labels, {"variable": "name"}).withColumns(
        {
            "estimate": F.col("estimate").try_cast("double"),
            "census_place_code": F.col("place_code").cast("string"),
        }
    ).drop("place_code")


def jurisdiction_estimate(units: DataFrame, county: str, places: list[str] = V.EXCLUDED_PLACES,
                          township: str = V.EXCLUDED_TOWNSHIP) -> DataFrame:
    """County minus excluded places minus one township, for every variable at once.

    units(geography, name, variable, value).  No excluded place sums to zero; a
    missing county or township value leaves no estimate.
    """
    geo, name, value = F.col("geography"), F.col("name"), F.col("value")
    whole = F.sum(F.when((geo == "county") & (name == county), value))
    is_place = (geo == "place") & name.isin(places)
    given = F.count_if(is_place & value.isNull()) == 0
    out = F.when(given, F.coalesce(F.sum(F.when(is_place, value)), F.lit(0.0)))
    town = F.sum(F.when((geo == "county subdivision") & (name == township), value))
    return units.groupBy("variable").agg((whole - out - town).alias("population"))


def with_sex_age(estimates: DataFrame, labels: DataFrame) -> DataFrame:
    """Estimates with sex and age read off the variable's label, population last."""
    rows = left_lookup(estimates, labels.select("name", "label"), {"variable": "name"})
    return rows.select(
        F.col("label").alias("group"), label_sex(F.col("label")).alias("sex"),
        label_age(F.col("label")).alias("age"), "population",
    )

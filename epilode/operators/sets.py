"""Set operations and gazetteer construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V
from epilode.operators.joins import member_flag


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column missing from one part is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, a_col: str, b: DataFrame, b_col: str, out: str = "area") -> DataFrame:
    """Distinct values of two columns, without lists (values with a comma)."""
    both = a.select(F.col(a_col).alias(out)).union(b.select(F.col(b_col).alias(out)))
    return both.distinct().filter(~F.col(out).contains(","))


def set_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of `a` that are not in `b`."""
    return a.subtract(b)


def add_row(df: DataFrame, **values) -> DataFrame:
    """Append one literal row."""
    row = [tuple(values.get(c) for c in df.columns)]
    return df.unionByName(df.sparkSession.createDataFrame(row, df.schema))


def build_city_list(places: DataFrame, name: str, members: DataFrame, member: str,
                    anchor: str = V.ANCHOR_TOWN, extra: str = V.EXTRA_PLACE) -> DataFrame:
    """City gazetteer: place names without their kind, flagged as in the county."""
    cities = places.select(F.regexp_replace(name, V.PLACE_SUFFIX, "").alias("city")).distinct()
    flagged = member_flag(cities, "city", members, member, "in_cook").withColumn(
        "in_cook", F.col("in_cook") | F.coalesce(F.col("city") == anchor, F.lit(False))
    )
    return add_row(flagged, city=extra, in_cook=True)


def build_zip_list(zctas: DataFrame, geoid: str, members: DataFrame, member: str) -> DataFrame:
    """Zip gazetteer: characters 3-7 of the state-prefixed id, flagged."""
    zips = zctas.select(F.substring(geoid, 3, 5).alias("zip"))
    return member_flag(zips, "zip", members, member, "subcook")

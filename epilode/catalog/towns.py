"""Part names as towns: misspelled entries and the reference lists.

Names starting `hot` or `new` are no cities; `hot` and `cold` names are areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilode.catalog.registry import Tables
from epilode.functions.text import title_case
from epilode.plans.town_matching import Gazetteer

ANCHOR = "Blue Ring"


def _damaged(name: Column, kind: Column, shift: Column) -> Column:
    k = (F.lit(1) + shift % F.length(name)).cast("int")
    before, after = F.substring(name, F.lit(1), k - 1), F.substring(name, k + 1, F.length(name))
    at, following = F.substring(name, k, F.lit(1)), F.substring(name, k + 1, F.lit(1))
    rest = F.substring(name, k + 2, F.length(name))
    return (
        F.when(kind == "STANDARD", F.concat(before, after))
        .when(kind == "PROMO", F.concat(before, following, at, rest))
        .when(kind == "SMALL", F.concat(before, F.lit("x"), after))
        .when(kind == "MEDIUM", F.concat(F.upper(name), F.lit(" Il")))
        .when(kind == "LARGE", F.concat(F.substring(name, F.lit(1), k), F.lit("e"), after))
        .otherwise(name)
    )


def _entry(shift: Column) -> dict[str, Column]:
    brand, size = F.col("p_brand"), F.col("p_size")
    town = (
        F.when((brand == "Brand#4") & (F.col("p_type") == "LARGE"), F.lit(None))
        .when((brand == "Brand#4") & (F.col("p_type") == "SMALL"), F.lit("unknown"))
        .otherwise(_damaged(F.col("p_name"), F.col("p_type"), shift))
    )
    zip_code = (
        F.when(brand == "Brand#1", F.lit(None))
        .when(brand == "Brand#2", F.concat(F.lit("X-"), size.cast("string")))
        .when(brand == "Brand#3", F.concat(brand, F.lit("-"), (51 - size).cast("string")))
        .otherwise(F.concat(brand, F.lit("-"), size.cast("string")))
    )
    return {"town": town, "zip": zip_code}


_DAMAGED_SQL = """
    CASE WHEN p_brand = 'Brand#4' AND p_type = 'LARGE' THEN NULL
         WHEN p_brand = 'Brand#4' AND p_type = 'SMALL' THEN 'unknown'
         WHEN p_type = 'STANDARD' THEN substr(p_name, 1, k - 1) || substr(p_name, k + 1)
         WHEN p_type = 'PROMO' THEN substr(p_name, 1, k - 1) || substr(p_name, k + 1, 1) || substr(p_name, k, 1) || substr(p_name, k + 2)
         WHEN p_type = 'SMALL' THEN substr(p_name, 1, k - 1) || 'x' || substr(p_name, k + 1)
         WHEN p_type = 'MEDIUM' THEN upper(p_name) || ' Il'
         WHEN p_type = 'LARGE' THEN substr(p_name, 1, k) || 'e' || substr(p_name, k + 1)
         ELSE p_name END AS town,
    CASE WHEN p_brand = 'Brand#1' THEN NULL
         WHEN p_brand = 'Brand#2' THEN 'X-' || p_size
         WHEN p_brand = 'Brand#3' THEN p_brand || '-' || (51 - p_size)
         ELSE p_brand || '-' || p_size END AS zip
"""

PART_TOWNS_SQL = f"""
    dirty AS (SELECT p_partkey, p_name, {_DAMAGED_SQL}
              FROM (SELECT *, 1 + p_size % length(p_name) AS k FROM part))"""
LINE_TOWNS_SQL = f"""
    dirty AS (SELECT l_orderkey, l_linenumber, l_partkey, {_DAMAGED_SQL}
              FROM (SELECT *, 1 + (p_size + l_linenumber) % length(p_name) AS k
                    FROM lineitem JOIN part ON l_partkey = p_partkey))"""
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
LISTS_SQL = f"""
    cities AS (SELECT DISTINCT {_TITLE} AS city, p_name < 'l' AS in_cook FROM part
               WHERE p_name NOT LIKE 'hot %' AND p_name NOT LIKE 'new %'),
    city_zips AS (SELECT DISTINCT p_brand || '-' || p_size AS zip, {_TITLE} AS city FROM part
                  WHERE p_name NOT LIKE 'hot %' AND p_name NOT LIKE 'new %'),
    areas AS (SELECT DISTINCT {_TITLE} AS area FROM part WHERE p_name LIKE 'hot %' OR p_name LIKE 'cold %'),
    state_zips AS (SELECT DISTINCT p_brand || '-' || p_size AS zip FROM part WHERE p_size <= 40)"""


def part_towns(t: Tables) -> DataFrame:
    """(p_partkey, p_name, town, zip), one entry per part."""
    return t.part.withColumns(_entry(F.col("p_size"))).select("p_partkey", "p_name", "town", "zip")


def line_towns(t: Tables) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, town, zip), one entry per order line."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    )
    return rows.withColumns(_entry(F.col("p_size") + F.col("l_linenumber"))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "town", "zip"
    )


def gazetteer(t: Tables) -> Gazetteer:
    """The four reference lists."""
    name = F.col("p_name")
    city_parts = t.part.filter(~name.startswith("hot ") & ~name.startswith("new "))
    zip_code = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))
    names = city_parts.select("p_name").distinct()
    zips = city_parts.select(zip_code.alias("zip"), "p_name").distinct()
    area = t.part.filter(name.startswith("hot ") | name.startswith("cold ")).select("p_name").distinct()
    title = title_case(name)
    return Gazetteer(
        cities=names.select(title.alias("ordinal"), title.alias("city"), (name < "l").alias("in_cook")),
        city_zips=zips.select(title.alias("ordinal"), "zip", title.alias("city")),
        areas=area.select(title.alias("ordinal"), title.alias("area")),
        state_zips=t.part.filter("p_size <= 40").select(zip_code.alias("zip")).distinct(),
    )

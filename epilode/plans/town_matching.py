"""Dirty town names (with zip) to gazetteer towns, by a ladder of tests.

Stages, in order; the first that answers wins:

 1 exact city                         6 zip outside the state: Jaro <= 0.10, final
 2 exact area that is no city         7 county cities, Jaro <= 0.25
 3 cities of the zip, Jaro <= 0.35;   8 the only city of the zip
   else an area, Jaro <= 0.20, if     9 any city, Jaro <= 0.20
   the zip holds the anchor town     10 no answer
 4 any city, Jaro <= 0.05
 5 the only city one edit away

All that does not depend on the zip is settled once per distinct town; stages 4,
6, 7 and 9 read one relation of scored pairs.  The (town, zip) pairs then only
look up their town, their zip and the cities of the zip.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilode.functions import distance as D
from epilode.functions import fixed_values as V
from epilode.functions.text import blank_to_null, normalise_town, title_case
from epilode.operators import matching as M
from epilode.operators.joins import city_in_zip, null_safe_join, single_city_zips
from epilode.session import cut_lineage

# Thresholds of the ladder.
IN_ZIP, IN_AREAS, VERY_CLOSE, OUT_OF_STATE, IN_COUNTY, ANYWHERE = 0.35, 0.2, 0.05, 0.1, 0.25, 0.2


@dataclass(frozen=True)
class Gazetteer:
    """Reference lists; `ordinal` is the place in the list and settles ties."""

    cities: DataFrame  # ordinal, city, in_cook
    city_zips: DataFrame  # ordinal, zip, city
    areas: DataFrame  # ordinal, area
    state_zips: DataFrame  # zip


def _town_answers(towns: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Everything the ladder can say about a town without its zip, one row per town."""
    cities = gaz.cities.select(F.col("city").alias("exact")).distinct()
    own_areas = gaz.areas.select(F.col("area").alias("own_area")).distinct().join(
        cities, F.col("own_area") == F.col("exact"), "left_anti"
    )
    known = cut_lineage(
        # Two steps, so that the chain of rules runs once per town.
        towns.withColumn("raw", normalise_town(F.col("town")))
        .withColumn("norm", blank_to_null(F.col("raw")))
        .drop("raw")
        .join(cities, F.col("norm") == F.col("exact"), "left")
        .join(own_areas, F.col("norm") == F.col("own_area"), "left"),
        "towns",
    )
    left_open = known.filter("norm is not null and exact is null and own_area is null").select("norm").distinct()
    names = left_open.select(F.lower("norm").alias("name")).distinct()
    options = gaz.cities.select(
        F.lower("city").alias("candidate"), "ordinal", F.col("city").alias("candidate_text"), "in_cook"
    )
    order, county = F.struct("distance", "ordinal"), F.col("in_cook")
    near = M.jaro_pairs(names, options, max(VERY_CLOSE, OUT_OF_STATE, IN_COUNTY, ANYWHERE)).groupBy("name").agg(
        F.min_by("candidate_text", order).alias("any_city"),
        F.min("distance").alias("any_distance"),
        F.min_by("candidate_text", F.when(county, order)).alias("county_city"),
        F.min(F.when(county, F.col("distance"))).alias("county_distance"),
    )
    edit = M.only_one_edit_away(left_open, "norm", gaz.cities, "city", "ordinal")
    area = M.closest(left_open, "norm", gaz.areas, "area", "ordinal", IN_AREAS)
    return (
        known.join(near.withColumnRenamed("name", "nn"), F.lower("norm") == F.col("nn"), "left")
        .join(edit.select(F.col("name").alias("en"), F.col("match").alias("edit_city")),
              F.lower("norm") == F.col("en"), "left")
        .join(area.select(F.col("name").alias("near_area")), F.col("norm") == F.col("near_area"), "left")
        .drop("nn", "en")
    )


def _zip_facts(gaz: Gazetteer, anchor: str) -> DataFrame:
    """Per listed zip: its only city, whether it holds the anchor town, whether in the state."""
    listed = gaz.city_zips.groupBy(F.col("zip").alias("z")).agg(
        F.count(F.lit(1)).alias("n"), F.min("city").alias("c"), F.bool_or(F.col("city") == anchor).alias("has_anchor")
    )
    state = gaz.state_zips.select(F.col("zip").alias("sz")).distinct()
    return listed.join(state, F.col("z") == F.col("sz"), "full").select(
        F.coalesce("z", "sz").alias("zz"), F.when(F.col("n") == 1, F.col("c")).alias("only_city"),
        F.coalesce("has_anchor", F.lit(False)).alias("has_anchor"), F.col("sz").isNotNull().alias("in_state"),
    )


def match_keys(keys: DataFrame, gaz: Gazetteer, anchor: str = V.ANCHOR_TOWN) -> DataFrame:
    """(town, zip) pairs with `clean` and `match_stage`."""
    keys = cut_lineage(keys.select("town", "zip").distinct(), "town_keys")
    towns = cut_lineage(_town_answers(keys.select("town").distinct(), gaz), "town_answers")
    open_ = F.col("norm").isNotNull() & F.col("exact").isNull() & F.col("own_area").isNull()
    rows = null_safe_join(keys, towns, ["town"])
    in_zip = M.closest_in_block(
        rows.filter(open_ & F.col("zip").isNotNull()), "norm", "zip", gaz.city_zips, "city", "zip", "ordinal", IN_ZIP
    )
    rows = rows.join(
        in_zip.select(F.col("name").alias("zn"), F.col("block").alias("zb"), F.col("match").alias("zip_city")),
        (F.col("norm") == F.col("zn")) & (F.col("zip") == F.col("zb")), "left",
    ).join(_zip_facts(gaz, anchor), F.col("zip") == F.col("zz"), "left")
    c = F.col

    def step(stage: int, value: Column) -> Column:
        return F.struct(value.cast("string").alias("clean"), F.lit(stage).alias("match_stage"))

    outside = c("zip").isNotNull() & ~F.coalesce("in_state", F.lit(False))
    decided = (
        F.when(c("norm").isNull(), step(0, F.lit(None)))
        .when(c("exact").isNotNull(), step(1, c("exact")))
        .when(c("own_area").isNotNull(), step(2, F.lit(anchor)))
        .when(c("zip_city").isNotNull(), step(3, c("zip_city")))
        .when(c("has_anchor") & c("near_area").isNotNull(), step(3, F.lit(anchor)))
        .when(c("any_distance") <= VERY_CLOSE, step(4, c("any_city")))
        .when(c("edit_city").isNotNull(), step(5, c("edit_city")))
        .when(outside, step(6, F.when(c("any_distance") <= OUT_OF_STATE, c("any_city"))))
        .when(c("county_distance") <= IN_COUNTY, step(7, c("county_city")))
        .when(c("only_city").isNotNull(), step(8, c("only_city")))
        .when(c("any_distance") <= ANYWHERE, step(9, c("any_city")))
        .otherwise(step(10, F.lit(None)))
    )
    return rows.select("town", "zip", decided.alias("d")).select("town", "zip", "d.clean", "d.match_stage")


def match_towns(df: DataFrame, town: str, zip_code: str | None, gaz: Gazetteer,
                anchor: str = V.ANCHOR_TOWN, out: str = "clean", stage: str = "match_stage") -> DataFrame:
    """`df` with the matched town and the stage that found it.

    `zip_code=None` matches without zip.
    """
    zips = F.col(zip_code).cast("string") if zip_code else F.lit(None).cast("string")
    keyed = df.withColumns({"__town": F.col(town), "__zip": zips})
    found = cut_lineage(
        match_keys(keyed.select(F.col("__town").alias("town"), F.col("__zip").alias("zip")), gaz, anchor), "matched"
    )
    found = found.select(
        F.col("town").alias("__town"), F.col("zip").alias("__zip"),
        F.col("clean").alias(out), F.col("match_stage").alias(stage),
    )
    return null_safe_join(keyed, found, ["__town", "__zip"]).drop("__town", "__zip")


def _method_answers(keys: DataFrame, gaz: Gazetteer, methods: tuple[str, ...], anchor: str, p: float, bt: float,
                    weight: tuple[float, float, float, float], table: bool) -> DataFrame:
    """`keys` (town, zip, name) with each method's answer, and with `table` its answer without zip (`_all`) too.

    Names are scored once against all cities, by all methods; (name, zip) pairs against
    the cities of their zip.
    """
    listed = gaz.city_zips.groupBy(F.col("zip").alias("lz")).agg(F.bool_or(F.col("city") == anchor).alias("has_anchor"))
    keys = cut_lineage(keys.join(listed, F.col("zip") == F.col("lz"), "left"), "method_keys")
    measures = {m: M.distance_of(m, p, bt, weight) for m in methods}
    squares = {m: (F.col("qa"), F.col("qb")) if m == "cosine" else () for m in methods}
    best = {m: F.min_by("city", F.struct(f"d_{m}", "ordinal")).alias(f"zip_{m}") for m in methods}
    blocked = (
        keys.filter("lz is not null and name is not null").select("name", "zip").distinct()
        .withColumn("qa", D.dot(F.col("name"), F.col("name")))
        .join(gaz.city_zips.select("zip", "ordinal", "city", D.dot(F.col("city"), F.col("city")).alias("qb")), "zip")
        .withColumns({f"d_{m}": measure[1](F.col("name"), F.col("city"), *squares[m]) for m, measure in measures.items()})
        .groupBy(F.col("name").alias("bn"), F.col("zip").alias("bz")).agg(*best.values())
    )
    free = keys if table else keys.filter("lz is null")
    anywhere = M.nearest_by(free, "name", gaz.cities, "city", "ordinal", methods, p, bt, weight).select(
        F.col("name").alias("fn"), *[F.col(f"{m}.match").alias(f"free_{m}") for m in methods]
    )
    areas = gaz.areas.select(F.col("area").alias("ar")).distinct()
    has_anchor = gaz.cities.agg(F.coalesce(F.bool_or(F.col("city") == anchor), F.lit(False))).scalar()
    rows = (
        keys.join(blocked, (F.col("name") == F.col("bn")) & (F.col("zip") == F.col("bz")), "left")
        .join(anywhere, F.col("name") == F.col("fn"), "left")
        .join(areas, F.col("name") == F.col("ar"), "left")
    )
    known, area = F.col("lz").isNotNull(), F.col("ar").isNotNull()
    out = {}
    for m in methods:
        near = F.when(known, F.col(f"zip_{m}")).otherwise(F.col(f"free_{m}"))
        out[m] = F.when(area & F.when(known, F.col("has_anchor")).otherwise(has_anchor), F.lit(anchor)).otherwise(near)
        if table:
            out[f"{m}_all"] = F.when(area & has_anchor, F.lit(anchor)).otherwise(F.col(f"free_{m}"))
    return rows.select("town", "zip", "name", *[c.alias(n) for n, c in out.items()])


def compare_methods(df: DataFrame, town: str, zip_code: str | None, gaz: Gazetteer, method: str = "jw",
                    anchor: str = V.ANCHOR_TOWN, p: float = 0.0, bt: float = 0.0,
                    weight: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """(town, zip, match): nearest candidate without threshold or case folding.

    `method`, `p`, `bt` and `weight` are those of `matching.nearest`.

    Candidates are the zip's cities if the zip is listed, else all cities; an
    exact area name means the anchor town when that is among the candidates.
    """
    zips = F.col(zip_code).cast("string") if zip_code else F.lit(None).cast("string")
    keys = df.select(F.col(town).alias("town"), zips.alias("zip")).distinct().withColumn("name", title_case(F.col("town")))
    return _method_answers(keys, gaz, (method,), anchor, p, bt, weight, False).select("town", "zip", F.col(method).alias("match"))


def method_table(df: DataFrame, town: str, zip_code: str, gaz: Gazetteer, anchor: str = V.ANCHOR_TOWN,
                 weight: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """Answers of the methods side by side, with and without zip: one row per (town, zip).

    `weight` is that of `osa`.

    `jw_dist` and `cos_dist` are the town's Jaro and cosine distance from `jw_all`.
    """
    keys = df.select(F.col(town).alias("town"), F.col(zip_code).cast("string").alias("zip")).distinct()
    out = _method_answers(keys.withColumn("name", title_case(F.col("town"))), gaz, ("jw", "cosine", "osa"), anchor, 0.0, 0.0, weight, True)
    return out.withColumns({"jw_dist": D.jaro(F.col("name"), F.col("jw_all")), "cos_dist": D.cosine(F.col("name"), F.col("jw_all"))}).drop("name")


def match_report(df: DataFrame, town: str, zip_code: str, with_zip: str, without_zip: str,
                 city_zips: DataFrame) -> DataFrame:
    """Flags for reviewing a matcher's answers row by row."""
    c = F.col
    rows = city_in_zip(df, with_zip, zip_code, city_zips, "in_zip")
    return rows.withColumns(
        {
            "changed": F.coalesce(c(with_zip) != title_case(c(town)), F.lit(False))
            | (c(town).isNotNull() & c(with_zip).isNull()),
            "null_mismatch": c(with_zip).isNull() != c(without_zip).isNull(),
            "zip_matters": ~c(with_zip).eqNullSafe(c(without_zip)),
            "distance_with_zip": D.jaro(c(town), c(with_zip)),
            "distance_without_zip": D.jaro(c(town), c(without_zip)),
        }
    )

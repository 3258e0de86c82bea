"""Recipes for the boundary layers; inputs are layers with `geom`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V
from epilode.functions.measures import area_sqmi
from epilode.functions.text import title_case
from epilode.operators import spatial as S
from epilode.operators.columns import drop_geometry, select_range
from epilode.operators.joins import left_lookup

# Label of the home jurisdiction in `location`; set by the caller.
HOME = "LOCAL"
# District outside the jurisdiction, its location classes.
OUTSIDE, OUTSIDE_CODE = "Outside", "OOJ"
SUBURBAN, ANCHOR = "SCC", V.ANCHOR_TOWN


def add_unit_areas(df: DataFrame, land: str, water: str, source_unit: str = "ft2") -> DataFrame:
    """Land, water and total square miles in place of the raw areas.

    The raw fields count as square feet by default; census files hold square
    metres, for which the caller names the unit.
    """
    return df.withColumns(
        {
            "area_land_sqmi": area_sqmi(F.col(land), source_unit),
            "area_water_sqmi": area_sqmi(F.col(water), source_unit),
        }
    ).withColumn("area_sqmi", F.col("area_land_sqmi") + F.col("area_water_sqmi")).drop(land, water)


def outside_code(district: Column) -> Column:
    """`Outside` is shown as its code."""
    return F.when(district == OUTSIDE, F.lit(OUTSIDE_CODE)).otherwise(district)


def location_class(district: Column, town: Column, home: str = HOME) -> Column:
    """Anchor town, other outside town, or home jurisdiction; NULL without a district."""
    return (
        F.when((district == OUTSIDE_CODE) & (town != ANCHOR), F.lit(SUBURBAN))
        .when((district == OUTSIDE_CODE) & (town == ANCHOR), F.lit(ANCHOR))
        .when(district != OUTSIDE_CODE, F.lit(home))
    )


def counties(layer: DataFrame, srid: int, source_unit: str = "ft2") -> DataFrame:
    """County names, areas and shapes."""
    rows = S.reproject(layer, srid, V.STATE_PLANE).select(
        F.col("GEOID").alias("geoid_county"), F.col("NAME").alias("name_county"),
        F.col("ALAND").alias("area_land"), F.col("AWATER").alias("area_water"), "geom", "srid",
    )
    return add_unit_areas(rows, "area_land", "area_water", source_unit)


def zctas(layer: DataFrame, national: DataFrame, srid: int, source_unit: str = "ft2") -> DataFrame:
    """County zip areas with the national table's areas."""
    areas = drop_geometry(national).select(
        F.col("GEOID20").alias("geoid_zcta"), F.col("ALAND20").alias("area_land"), F.col("AWATER20").alias("area_water")
    )
    rows = layer.select(
        F.col("zcta").alias("geoid_zcta"), F.col("prmry_c").alias("primary_city"),
        F.col("prtl_pp").alias("partial"), F.col("prcnt_d").alias("percent"), "notes", "geom", "srid",
    ).dropna(subset=["geoid_zcta"])
    joined = left_lookup(rows, areas.withColumnRenamed("geoid_zcta", "g"), {"geoid_zcta": "g"})
    return S.reproject(add_unit_areas(joined, "area_land", "area_water", source_unit), srid, V.STATE_PLANE)


def municipalities(layer: DataFrame, places: DataFrame, srid: int, home: str = HOME,
                   source_unit: str = "ft2") -> DataFrame:
    """Municipalities with id, location class, district and areas, by name."""
    attributes = drop_geometry(places).select(
        "NAME", F.col("GEOID").alias("geoid_place"), F.col("ALAND").alias("area_land"),
        F.col("AWATER").alias("area_water"),
    )
    rows = left_lookup(layer.dropna(subset=["muni_name"]), attributes, {"muni_name": "NAME"})
    rows = add_unit_areas(rows, "area_land", "area_water", source_unit).withColumn(
        "location", location_class(F.col("district"), F.col("muni_name"), home)
    )
    out = rows.select(
        F.col("muni_name").alias("name_place"), "geoid_place", "location", "district",
        "partial", "exclude", "area_land_sqmi", "area_water_sqmi", "area_sqmi", "geom", "srid",
    )
    return S.reproject(out, srid, V.STATE_PLANE).orderBy(F.col("name_place").asc_nulls_last())


def jurisdiction_boundary(county: DataFrame, places: DataFrame, townships: DataFrame, srid: int,
                          name: str = "boundary", state_fp: str = "17", county_fp: str = "031",
                          noded: bool = False) -> DataFrame:
    """The county without the excluded places and townships: one multipolygon and its area."""
    def moved(layer: DataFrame) -> DataFrame:
        return S.reproject(layer, srid, V.STATE_PLANE)

    mask = moved(places.filter(F.col("NAME").isin(V.MASK_PLACES)).select("geom")).unionByName(
        moved(townships.filter((F.col("COUNTYFP") == county_fp) & F.col("NAME").isin(V.MASK_TOWNSHIPS)).select("geom"))
    )
    base = moved(county.filter((F.col("STATEFP") == state_fp) & (F.col("COUNTYFP") == county_fp)).select("geom"))
    rings = S.assemble_rings(S.clip(base, mask, noded))
    shapes = S.rings_to_shape(rings)
    whole = shapes.agg(F.array_sort(F.collect_list(F.struct("ring_id", F.col("geom")[0].alias("p")))).alias("a")).select(
        F.lit(name).alias("name"), F.transform("a", lambda x: x["p"]).alias("geom")
    )
    return S.set_crs(S.add_area(whole), V.STATE_PLANE)


def districts_by_municipality(layer: DataFrame) -> DataFrame:
    """Districts with the outside code and their shape's area."""
    return S.add_area(layer.withColumn("district", outside_code(F.col("district"))))


def districts_by_tract(layer: DataFrame) -> DataFrame:
    """Districts drawn from tracts, title-cased, with their shape's area."""
    rows = layer.drop("sqmi").withColumnsRenamed({"tracts": "num_tracts_2020", "district": "name_district"})
    return S.add_area(rows.withColumn("name_district", outside_code(title_case(F.col("name_district")))))


def _tract_names(layer: DataFrame, geoid: str) -> DataFrame:
    rows = layer.drop("sqmi").withColumnsRenamed({"fips": geoid, "district": "name_district"})
    location = F.upper("location")
    return rows.withColumns(
        {
            "name_district": outside_code(title_case(F.col("name_district"))),
            "location": F.when(location == ANCHOR.upper(), F.lit(ANCHOR)).otherwise(location),
        }
    )


def tracts_2010(layer: DataFrame, national: DataFrame) -> DataFrame:
    """2010 tracts with the census name and area."""
    names = drop_geometry(national).select(
        F.concat("STATE", "COUNTY", "TRACT").alias("g"), F.col("NAME").alias("name_tract_2010"),
        F.col("CENSUSAREA").alias("area_sqmi"),
    )
    return left_lookup(_tract_names(layer, "geoid_tract_2010"), names, {"geoid_tract_2010": "g"})


def tracts_2020(layer: DataFrame, national: DataFrame, source_unit: str = "ft2") -> DataFrame:
    """2020 tracts with the census name and areas."""
    raw = drop_geometry(national).select(
        F.col("GEOID").alias("g"), F.col("NAME").alias("name_tract_2020"),
        F.col("ALAND").alias("area_land"), F.col("AWATER").alias("area_water"),
    )
    areas = add_unit_areas(raw, "area_land", "area_water", source_unit)
    names = select_range(areas, "area_land_sqmi", "area_sqmi", ["g", "name_tract_2020"])
    return left_lookup(_tract_names(layer, "geoid_tract_2020"), names, {"geoid_tract_2020": "g"})

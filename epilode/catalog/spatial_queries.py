"""Layers.  Parts and suppliers become boxes whose density does not change with scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.catalog.registry import query, title_sql
from epilode.functions import fixed_values as V
from epilode.functions import geometry as G
from epilode.operators import spatial as S
from epilode.plans import layers as L
from epilode.session import fresh_path
from epilode.sources.layers import read_layer_path, read_region, write_layer_path, write_layer_regions

_PARTS_SQL = """
    p AS (SELECT p_partkey, p_partkey * 10.0 AS x1, CAST(p_size AS DOUBLE) AS y1,
                 p_partkey * 10.0 + 2 + p_size AS x2, p_size + 1.0 + p_retailprice / 100 AS y2 FROM part),
    s AS (SELECT s_suppkey, s_suppkey * 200.0 AS x1, CAST(s_nationkey AS DOUBLE) AS y1,
                 s_suppkey * 200.0 + 150 AS x2, s_nationkey + 20.0 AS y2 FROM supplier)
"""


def _parts(t) -> DataFrame:
    x, size = F.col("p_partkey") * 10.0, F.col("p_size").cast("double")
    return t.part.select(
        "p_partkey", "p_name", G.box(x, size, x + 2 + size, size + 1.0 + F.col("p_retailprice") / 100).alias("geom")
    )


def _suppliers(t) -> DataFrame:
    x, y = F.col("s_suppkey") * 200.0, F.col("s_nationkey").cast("double")
    return t.supplier.select("s_suppkey", G.box(x, y, x + 150, y + 20).alias("geom"))


_MEETS = "p.x1 <= s.x2 AND s.x1 <= p.x2 AND p.y1 <= s.y2 AND s.y1 <= p.y2"


@query("join_spatial_intersects", f"WITH {_PARTS_SQL} SELECT p_partkey, s_suppkey FROM p JOIN s ON {_MEETS}")
def _intersects(t):
    return S.intersects(_parts(t), "p_partkey", _suppliers(t), "s_suppkey")


@query(
    "sp_intersects",
    f"WITH {_PARTS_SQL} SELECT s_suppkey, count(*) AS n FROM p JOIN s ON {_MEETS} GROUP BY s_suppkey",
)
def _intersect_counts(t):
    pairs = S.intersects(_suppliers(t), "s_suppkey", _parts(t), "p_partkey")
    return pairs.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sp_area",
    f"WITH {_PARTS_SQL} SELECT p_partkey, round((x2 - x1) * (y2 - y1) * 1000000 / 27878400.0, 6) AS area_msqmi FROM p",
)
def _area(t):
    layer = S.add_area(_parts(t))
    return layer.select("p_partkey", F.round(F.col("area_sqmi") * 1000000, 6).alias("area_msqmi"))


@query(
    "sp_set_crs",
    "SELECT p_partkey, 3435 AS srid FROM part",
)
def _crs(t):
    return S.set_crs(_parts(t), 3435).select("p_partkey", "srid")


# The ellipsoid and the state-plane zone, in metres, degrees and survey feet.
_A, _N, _K0 = 6378137.0, (1 / 298.257222101) / (2 - 1 / 298.257222101), 0.999975
_E2 = 4 * _N / (1 + _N) ** 2


def _meridian_sql(phi: str) -> str:
    """Length of the meridian up to a latitude, by Helmert's series."""
    n = _N
    terms = [
        (1 + n**2 / 4 + n**4 / 64, phi), (-1.5 * (n - n**3 / 8), f"sin(2 * {phi})"), (15 / 16 * (n**2 - n**4 / 4), f"sin(4 * {phi})"),
        (-35 / 48 * n**3, f"sin(6 * {phi})"), (315 / 512 * n**4, f"sin(8 * {phi})"),
    ]
    return f"({_A / (1 + n)!r}::DOUBLE * (" + " + ".join(f"{c!r}::DOUBLE * {t}" for c, t in terms) + "))"


@query(
    "sp_reproject",
    f"""
    WITH g AS (SELECT p_partkey, radians(36.5 + p_partkey % 1000 * 0.006) AS phi, radians((p_size - 25) * 0.025) AS lam FROM part),
         q AS (SELECT *, {_A}::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * sin(phi) ** 2) AS nu, tan(phi) ** 2 AS t,
                      {_E2 / (1 - _E2)!r}::DOUBLE * cos(phi) ** 2 AS c, lam * cos(phi) AS a,
                      {_meridian_sql('phi')} - {_meridian_sql('radians(36 + 2.0 / 3)')} AS m FROM g)
    SELECT p_partkey, 3435 AS srid,
      round((300000 + {_K0} * nu * (a + (1 - t + c) * a ** 3 / 6
        + (5 - 18 * t + t ** 2 + 72 * c - 58 * {_E2 / (1 - _E2)!r}::DOUBLE) * a ** 5 / 120)) * 3937 / 1200, 1) AS x,
      round({_K0} * (m + nu * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * a ** 4 / 24
        + (61 - 58 * t + t ** 2 + 600 * c - 330 * {_E2 / (1 - _E2)!r}::DOUBLE) * a ** 6 / 720)) * 3937 / 1200, 1) AS y
    FROM q
    """,
)
def _reproject(t):
    # Points across the zone; the SQL takes another series than the operator.
    lon, lat = -(88 + F.lit(1.0) / 3) + (F.col("p_size") - 25) * 0.025, 36.5 + F.col("p_partkey") % 1000 * 0.006
    layer = S.set_crs(t.part.select("p_partkey", G.box(lon, lat, lon + 0.001, lat + 0.001).alias("geom")), 4326)
    moved = S.reproject(layer, 4326, 3435)
    corner = F.col("geom")[0][0][0]
    return moved.select("p_partkey", "srid", F.round(corner["x"], 1).alias("x"), F.round(corner["y"], 1).alias("y"))


_STRIP_SQL = "SELECT p_partkey * 10.0 AS x1, p_partkey * 10.0 + 10 AS x2, 0.0 AS y1, 1.0 + p_size % 2 AS y2 FROM part"


@query("sp_dissolve", f"SELECT round(sum((x2 - x1) * (y2 - y1)), 4) AS area FROM ({_STRIP_SQL})")
def _dissolve(t):
    # A strip of neighbours of uneven height: not noded.
    x = F.col("p_partkey") * 10.0
    layer = t.part.select(G.box(x, F.lit(0.0), x + 10, 1.0 + F.col("p_size") % 2).alias("geom"))
    return S.edge_area(S.dissolve(layer)).select(F.round("area", 4).alias("area"))


@query(
    "agg_dissolve",
    "SELECT p_size % 2 AS side, 2 * count(*) AS level_edges FROM part GROUP BY p_size % 2",
)
def _dissolve_noded(t):
    # Two rows of neighbours with matching edges, told apart by height.
    x, y = F.col("p_partkey") * 10.0, (F.col("p_size") % 2) * 5.0
    outline = S.dissolve(t.part.select(G.box(x, y, x + 10, y + 1).alias("geom")), noded=True)
    side = F.when(F.col("y1") >= 5, F.lit(1)).otherwise(F.lit(0))
    level = outline.filter("y1 = y2")
    return level.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("level_edges"))


@query(
    "sp_clip",
    "SELECT round(sum(10 * 3.0) - sum(4 * (1.0 + p_size % 2)), 4) AS area FROM part",
)
def _clip(t):
    x = F.col("p_partkey") * 10.0
    base = t.part.select(G.box(x, F.lit(0.0), x + 10, F.lit(3.0)).alias("geom"))
    # Masks reach below the base.
    mask = t.part.select(G.box(x + 3, F.lit(-1.0), x + 7, 1.0 + F.col("p_size") % 2).alias("geom"))
    return S.edge_area(S.clip(base, mask)).select(F.round("area", 4).alias("area"))


# A county's cut by a slanted water line: m = height * share, a fixed value that keeps all corners finite decimals.
_SHARES = (0.5, 0.56)


@query(
    "sp_clip_slanted",
    """
    WITH t AS (SELECT p_partkey, 4.0::DOUBLE + p_size % 7 AS h, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE ELSE 0.56::DOUBLE END AS c FROM part)
    SELECT p_partkey, round(5 * h - 5 * (2 * c * h / (c + 2)) - 0.5 * 0.8 * 0.12 * h, 4) AS area FROM t
    """,
)
def _clip_slanted(t):
    """A triangle with a triangular hole per part, less the triangle under a slanted line."""
    key, h = F.col("p_partkey"), F.lit(4.0) + F.col("p_size") % 7
    x, m = key * 10.0, h * F.when(F.col("p_size") % 2 == 0, _SHARES[0]).otherwise(_SHARES[1])
    outline = G.ring((x, 0 * h), (x + 10, 0 * h), (x + 5, h))
    hole = G.ring((x + 4.6, F.round(h * 0.68, 2)), (x + 5.4, F.round(h * 0.68, 2)), (x + 5, F.round(h * 0.8, 2)))
    layer = t.part.select(F.array(F.array(outline, hole)).alias("geom"))
    mask = t.part.select(F.array(F.array(G.ring((x, 0 * h), (x + 10, 0 * h), (x + 10, F.round(m, 4))))).alias("geom"))
    pieces = S.clip(layer, mask).withColumn("p_partkey", F.floor((F.col("x1") + F.col("x2")) / 20).cast("long"))
    return S.edge_area(pieces, "p_partkey").select("p_partkey", F.round("area", 4).alias("area"))


@query(
    "src_layer_read",
    f"WITH {_PARTS_SQL} SELECT p_partkey, 3435 AS srid, x1, y1, x2, y2 FROM p",
)
def _layer_read(t):
    path = fresh_path(t.spark, "layer")
    write_layer_path(S.set_crs(_parts(t), 3435).drop("p_name"), path)
    rows = read_layer_path(t.spark, path)
    return rows.select("p_partkey", "srid", G.bounds(F.col("geom")).alias("b")).select("p_partkey", "srid", "b.*")


@query(
    "src_layer_region",
    f"""
    WITH {_PARTS_SQL}, m AS (SELECT max(p_partkey) AS k FROM part)
    SELECT p_partkey, 3435 AS srid, x1, y1, x2, y2 FROM p, m WHERE x2 >= k * 2.5 AND x1 <= k * 5.0 AND y2 >= 20 AND y1 <= 40
    """,
)
def _layer_region(t):
    """A quarter of the layer's length, read from files that are ordered by place."""
    path = fresh_path(t.spark, "layer")
    write_layer_regions(S.set_crs(_parts(t), 3435).drop("p_name"), path)
    last = t.part.agg(F.max("p_partkey").alias("k")).first()["k"] or 0
    rows = read_region(t.spark, path, (last * 2.5, 20.0, last * 5.0, 40.0))
    return rows.select("p_partkey", "srid", G.bounds(F.col("geom")).alias("b")).select("p_partkey", "srid", "b.*")


@query(
    "sink_layer_write",
    f"""
    WITH {_PARTS_SQL} SELECT p_partkey, 3435 AS srid, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM p
    """,
)
def _layer_write(t):
    # The layer is in degrees and says so; it is stored in the home system.
    path = fresh_path(t.spark, "layer")
    degrees = S.reproject(_parts(t).drop("p_name"), 3435, 4326)
    write_layer_path(degrees, path)
    stored = t.spark.read.parquet(path)
    b = stored.select("p_partkey", "srid", G.bounds(G.from_wkb(F.col("geom_wkb"))).alias("b"))
    return b.select("p_partkey", "srid", *[F.round(f"b.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "sp_layer_build",
    f"""
    WITH {_PARTS_SQL}, m AS (SELECT p.*, p_name, p_type, p_size, p_retailprice FROM p JOIN part USING (p_partkey))
    SELECT p_partkey AS geoid_county, p_name AS name_county, round(p_retailprice * 1000 / 27.8784, 6) AS land,
           round((p_retailprice + p_size) * 1000 / 27.8784, 6) AS total, 3435 AS srid FROM m
    """,
)
def _layer_build(t):
    layer = S.set_crs(_parts(t), 3435).join(t.part.select("p_partkey", "p_retailprice", "p_size"), "p_partkey").select(
        F.col("p_partkey").alias("GEOID"), F.col("p_name").alias("NAME"), (F.col("p_retailprice") * 1e6).alias("ALAND"),
        (F.col("p_size") * 1e6).alias("AWATER"), "geom", "srid",
    )
    out = L.counties(layer, 3435)
    return out.select(
        "geoid_county", "name_county", F.round(F.col("area_land_sqmi") * 1000, 6).alias("land"),
        F.round(F.col("area_sqmi") * 1000, 6).alias("total"), "srid",
    )


def _census(t, **names: str) -> DataFrame:
    """Areas of the parts as a national table, under its own column names."""
    land, water = F.col("p_retailprice") * 1e6, F.col("p_size") * 1e6
    return t.part.select(F.col("p_partkey").cast("string").alias(names["key"]), land.alias(names["land"]), water.alias(names["water"]))


def _thousandths(*columns: str) -> list:
    return [F.round(F.col(c) * 1000, 6).alias(c) for c in columns]


_AREAS_SQL = """round(p_retailprice * 1000 / 27.8784, 6) AS area_land_sqmi, round((p_retailprice + p_size) * 1000 / 27.8784, 6) AS area_sqmi"""


@query(
    "sp_layer_zctas",
    f"""
    SELECT CAST(p_partkey AS VARCHAR) AS geoid_zcta, p_name AS primary_city, p_type AS partial, p_size AS percent, p_brand AS notes,
           {_AREAS_SQL}, 3435 AS srid FROM part WHERE p_type <> 'PROMO'
    """,
)
def _layer_zctas(t):
    layer = S.set_crs(_parts(t).drop("p_name"), 3435).join(t.part, "p_partkey").select(
        F.when(F.col("p_type") != "PROMO", F.col("p_partkey").cast("string")).alias("zcta"), F.col("p_name").alias("prmry_c"),
        F.col("p_type").alias("prtl_pp"), F.col("p_size").alias("prcnt_d"), F.col("p_brand").alias("notes"), "geom", "srid",
    )
    national = _census(t, key="GEOID20", land="ALAND20", water="AWATER20").withColumn("geom", F.lit(None))
    out = L.zctas(layer, national, 3435)
    return out.select(
        "geoid_zcta", "primary_city", "partial", "percent", "notes", *_thousandths("area_land_sqmi", "area_sqmi"), "srid"
    )


@query(
    "sp_layer_municipalities",
    f"""
    WITH p AS (SELECT *, CASE WHEN p_type = 'PROMO' THEN 'Chicago' ELSE p_name || ' ' || p_partkey END AS name_place,
                      CASE WHEN p_size % 3 = 0 THEN 'OOJ' ELSE p_brand END AS district FROM part),
         a AS (SELECT p_partkey, {_AREAS_SQL} FROM part WHERE p_type <> 'PROMO')
    SELECT name_place, CAST(a.p_partkey AS VARCHAR) AS geoid_place,
           CASE WHEN district = 'OOJ' AND name_place <> 'Chicago' THEN 'SCC' WHEN district = 'OOJ' THEN 'Chicago' ELSE 'LOCAL' END AS location,
           district, area_land_sqmi, area_sqmi FROM p LEFT JOIN a USING (p_partkey)
    """,
)
def _layer_municipalities(t):
    name = F.when(F.col("p_type") == "PROMO", F.lit("Chicago")).otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    layer = S.set_crs(_parts(t).drop("p_name"), 3435).join(t.part, "p_partkey").select(
        name.alias("muni_name"), F.when(F.col("p_size") % 3 == 0, F.lit("OOJ")).otherwise(F.col("p_brand")).alias("district"),
        F.lit(None).cast("string").alias("partial"), F.lit(None).cast("string").alias("exclude"), "geom", "srid",
    )
    places = _census(t, key="GEOID", land="ALAND", water="AWATER").join(
        t.part.filter("p_type <> 'PROMO'").select(F.col("p_partkey").cast("string").alias("GEOID"), name.alias("NAME")), "GEOID"
    ).withColumn("geom", F.lit(None))
    out = L.municipalities(layer, places, 3435)
    return out.select("name_place", "geoid_place", "location", "district", *_thousandths("area_land_sqmi", "area_sqmi"))


@query(
    "sp_layer_districts",
    f"""
    WITH {_PARTS_SQL}, d AS (SELECT p.*, p_name, p_type, (x2 - x1) * (y2 - y1) * 1000000 / 27878400.0 AS area FROM p JOIN part USING (p_partkey))
    SELECT p_partkey, 'municipality' AS recipe, CASE WHEN p_type = 'PROMO' THEN 'OOJ' ELSE p_name END AS district,
           round(area, 6) AS area_msqmi FROM d
    UNION ALL
    SELECT p_partkey, 'tract', CASE WHEN p_type = 'PROMO' THEN 'OOJ' ELSE {title_sql('p_name')} END, round(area, 6) FROM d
    """,
)
def _layer_districts(t):
    rows = _parts(t).join(t.part.select("p_partkey", "p_type"), "p_partkey")
    shown = F.when(F.col("p_type") == "PROMO", F.lit("Outside")).otherwise(F.col("p_name"))
    by_place = L.districts_by_municipality(rows.select("p_partkey", shown.alias("district"), "geom"))
    raw = F.when(F.col("p_type") == "PROMO", F.lit("outside")).otherwise(F.col("p_name"))
    by_tract = L.districts_by_tract(rows.select("p_partkey", raw.alias("district"), F.lit(1).alias("tracts"), F.lit(0.0).alias("sqmi"), "geom"))
    area = F.round(F.col("area_sqmi") * 1000000, 6).alias("area_msqmi")
    return by_place.select("p_partkey", F.lit("municipality").alias("recipe"), "district", area).unionByName(
        by_tract.select("p_partkey", F.lit("tract").alias("recipe"), F.col("name_district").alias("district"), area)
    )


@query(
    "sp_layer_tracts",
    f"""
    WITH d AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS fips, {title_sql('p_name')} AS name_district,
                      CASE WHEN p_type = 'PROMO' THEN 'Chicago' ELSE p_type END AS location, p_brand, p_size, p_retailprice FROM part)
    SELECT 2010 AS year, fips, name_district, location, p_brand AS name_tract, round(p_retailprice, 6) AS area FROM d
    UNION ALL
    SELECT 2020, fips, name_district, location, p_brand, round((p_retailprice + p_size) * 1000 / 27.8784, 6) FROM d
    """,
)
def _layer_tracts(t):
    fips = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    layer = t.part.select(
        fips.alias("fips"), F.col("p_name").alias("district"),
        F.when(F.col("p_type") == "PROMO", F.lit("chicago")).otherwise(F.col("p_type")).alias("location"), F.lit(0.0).alias("sqmi"),
    )
    old = t.part.select(
        F.substring(fips, 1, 2).alias("STATE"), F.substring(fips, 3, 3).alias("COUNTY"), F.substring(fips, 6, 6).alias("TRACT"),
        F.col("p_brand").alias("NAME"), F.col("p_retailprice").alias("CENSUSAREA"), F.lit(None).alias("geom"),
    )
    new = t.part.select(
        fips.alias("GEOID"), F.col("p_brand").alias("NAME"), (F.col("p_retailprice") * 1e6).alias("ALAND"),
        (F.col("p_size") * 1e6).alias("AWATER"), F.lit(None).alias("geom"),
    )
    first, second = L.tracts_2010(layer, old), L.tracts_2020(layer, new)
    return first.select(
        F.lit(2010).alias("year"), F.col("geoid_tract_2010").alias("fips"), "name_district", "location",
        F.col("name_tract_2010").alias("name_tract"), F.round("area_sqmi", 6).alias("area"),
    ).unionByName(second.select(
        F.lit(2020).alias("year"), F.col("geoid_tract_2020").alias("fips"), "name_district", "location",
        F.col("name_tract_2020").alias("name_tract"), F.round(F.col("area_sqmi") * 1000, 6).alias("area"),
    ))


@query(
    "sp_layer_boundary",
    """
    WITH c AS (SELECT max(p_partkey) * 10.0 + 30 AS w FROM part),
         m AS (SELECT sum(4 * (1.0 + p_size % 2)) AS a, count(*) AS holes FROM part WHERE p_type = 'PROMO'),
         s AS (SELECT count(*) * 5 * 2.0 AS a, count(*) AS holes FROM supplier WHERE s_nationkey < 5)
    SELECT 'home' AS name, 3435 AS srid, 1 AS polygons, CAST(1 + m.holes + s.holes AS INTEGER) AS rings,
           round(w * 40 - m.a - s.a, 4) AS area FROM c, m, s
    """,
)
def _layer_boundary(t):
    width = t.part.agg(F.max("p_partkey") * 10.0 + 30)
    county = width.toDF("w").select(
        F.lit("17").alias("STATEFP"), F.lit("031").alias("COUNTYFP"), G.box(F.lit(0.0), F.lit(-20.0), F.col("w"), F.lit(20.0)).alias("geom")
    )
    x = F.col("p_partkey") * 10.0
    places = t.part.select(
        F.when(F.col("p_type") == "PROMO", F.lit(V.MASK_PLACES[0])).otherwise(F.col("p_name")).alias("NAME"),
        G.box(x + 3, F.lit(1.0), x + 7, 2.0 + F.col("p_size") % 2).alias("geom"),
    )
    sx = F.col("s_suppkey") * 10.0
    townships = t.supplier.select(
        F.lit("031").alias("COUNTYFP"), F.when(F.col("s_nationkey") < 5, F.lit(V.MASK_TOWNSHIPS[0])).otherwise(F.col("s_name")).alias("NAME"),
        G.box(sx, F.lit(-5.0), sx + 5, F.lit(-3.0)).alias("geom"),
    )
    out = L.jurisdiction_boundary(county, places, townships, 3435, "home")
    return out.select(
        "name", "srid", F.size("geom").alias("polygons"), F.aggregate("geom", F.lit(0), lambda n, p: n + F.size(p)).alias("rings"),
        F.round(G.area(F.col("geom")), 4).alias("area"),
    )

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from epilode.functions import geometry as G
from epilode.operators import spatial as S
from epilode.plans import layers as L
from epilode.sources import layers as IO


def boxes(spark, *items, key="id"):
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(items)], f"{key} int, a double, b double, c double, d double")
    return df.select(key, G.box(*[F.col(x) for x in "abcd"]).alias("geom"))


def polygons(spark, *rings, key="id"):
    data = [(i, [[[(float(x), float(y)) for x, y in [*r, r[0]]]]]) for i, r in enumerate(rings)]
    return spark.createDataFrame(data, f"{key} int, geom {G.GEOM}")


def area(edges):
    return edges and S.edge_area(edges).first()["area"]


def test_area_with_hole(spark):
    wkt = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"
    got = spark.range(1).select(G.area(G.from_wkt(F.lit(wkt))).alias("a")).first()["a"]
    assert got == 15
    sqmi = S.add_area(boxes(spark, (0, 0, 5280, 5280))).first()["area_sqmi"]
    assert sqmi == pytest.approx(1)


def test_formats_round_trip(spark):
    text = "MULTIPOLYGON (((0.0 0.0, 4.5 0.0, 4.5 4.0, 0.0 0.0)), ((9.0 9.0, 10.0 9.0, 10.0 -1.0E-7, 9.0 9.0)))"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(G.from_wkt(F.col("t")).alias("g"))
    out = row.select(G.to_wkt(F.col("g")).alias("t"), G.to_wkt(G.from_wkb(G.to_wkb(F.col("g")))).alias("b")).collect()
    assert out[0]["t"] == out[0]["b"] == text
    assert out[1]["b"] is None


def test_extended_binary_is_refused(spark):
    import struct

    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    plain = struct.pack("<BII", 1, 3, 1) + ring
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    df = spark.createDataFrame([(plain,), (big,), (None,)], "b binary").select(G.to_wkt(G.from_wkb(F.col("b"))).alias("t"))
    text = "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)))"
    assert [r["t"] for r in df.collect()] == [text, text, None]
    tagged = struct.pack("<BIII", 1, 3 | 0x20000000, 4326, 1) + ring
    with pytest.raises(Exception, match="no plain polygon"):
        spark.createDataFrame([(tagged,)], "b binary").select(G.from_wkb(F.col("b"))).collect()
    empty = spark.createDataFrame([([],)], f"g {G.GEOM}").select(G.to_wkt(G.from_wkb(G.to_wkb(F.col("g")))).alias("t"))
    assert empty.first()["t"] == "MULTIPOLYGON ()"


def test_projection(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(-91.5, -87), rng.uniform(36.9, 42.6)) for _ in range(200)]
    df = spark.createDataFrame(pts, "x double, y double")
    there = df.select("x", "y", G.reproject_point(F.col("x"), F.col("y"), 4326, 3435).alias("p"))
    back = there.select("x", "y", G.reproject_point(F.col("p.x"), F.col("p.y"), 3435, 4326).alias("q"), "p")
    again = back.select("*", G.reproject_point(F.col("q.x"), F.col("q.y"), 4326, 3435).alias("r")).collect()
    for r in again:
        assert abs(r["q"]["x"] - r["x"]) < 1e-11 and abs(r["q"]["y"] - r["y"]) < 1e-11
        assert abs(r["r"]["x"] - r["p"]["x"]) < 1e-6 and abs(r["r"]["y"] - r["p"]["y"]) < 1e-6
    origin = spark.range(1).select(G.reproject_point(F.lit(-(88 + 1 / 3)), F.lit(36 + 2 / 3), 4326, 3435).alias("p")).first()["p"]
    assert origin["x"] == pytest.approx(984250.0, abs=1e-4) and origin["y"] == pytest.approx(0, abs=1e-4)


def test_touching_counts(spark):
    a = boxes(spark, (0, 0, 1, 1), (10, 10, 20, 20), key="p")
    b = boxes(spark, (1, 0, 2, 1), (1, 1, 2, 2), (1.001, 0, 2, 1), (12, 12, 13, 13), (0, 5, 30, 30), key="q")
    got = {tuple(r) for r in S.intersects(a, "p", b, "q").collect()}
    assert got == {(0, 0), (0, 1), (1, 3), (1, 4)}


def star(rng, cx, cy, r, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.5, 1) * math.cos(t), cy + r * rng.uniform(0.5, 1) * math.sin(t)) for t in angles]


def crosses(p, q, r, s):
    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)
    return side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0


def inside(p, ring):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def edge_list(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def test_intersects_equals_brute_force(spark):
    rng = random.Random(9)
    a = [star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0.5, 6), 7) for _ in range(30)]
    b = [star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0.5, 6), 9) for _ in range(30)]
    got = {tuple(r) for r in S.intersects(polygons(spark, *a, key="p"), "p", polygons(spark, *b, key="q"), "q").collect()}
    want = {
        (i, j) for i, x in enumerate(a) for j, y in enumerate(b)
        if any(crosses(*e, *f) for e in edge_list(x) for f in edge_list(y)) or inside(x[0], y) or inside(y[0], x)
    }
    assert got == want


def test_dissolve(spark):
    two = boxes(spark, (0, 0, 1, 1), (1, 0, 2, 1))
    for noded in (True, False):
        out = S.dissolve(two, noded=noded)
        assert out.count() == 6 and area(out) == pytest.approx(2)
    assert area(S.dissolve(boxes(spark, (0, 0, 2, 2), (1, 1, 3, 3), (1.2, 1.2, 1.4, 1.4), (9, 9, 10, 10)))) == pytest.approx(8)
    assert S.is_noded(two) and not S.is_noded(boxes(spark, (0, 0, 1, 1), (1, 0, 2, 2)))


def test_clip(spark):
    county, centre = boxes(spark, (0, 0, 3, 3)), boxes(spark, (1, 1, 2, 2))
    for noded in (True, False):
        assert area(S.clip(county, centre, noded=noded)) == pytest.approx(8)
    out = S.clip(county, boxes(spark, (-1, -1, 1.5, 1.5), (1, 1, 2, 2), (2.5, 2.5, 4, 4)))
    assert area(out) == pytest.approx(9 - 2.25 - 0.75 - 0.25)
    assert S.clip(county, boxes(spark, (-1, -1, 4, 4))).count() == 0


def test_slivers_and_small_units_are_kept(spark):
    far = boxes(spark, (50, 50, 51, 51))
    assert area(S.clip(boxes(spark, (0, 0, 0.00005, 0.00005)), far)) == pytest.approx(2.5e-9, rel=1e-6)
    two = S.dissolve(boxes(spark, (0, 0, 1, 1), (3, 0, 3.00001, 1)))
    assert area(two) == pytest.approx(1.00001, abs=1e-9) and two.count() == 8
    gap = S.dissolve(boxes(spark, (0, 0, 1, 1), (1.00001, 0, 2, 1)))
    assert gap.count() == 8 and area(gap) == pytest.approx(1.99999, abs=1e-9)
    degrees = S.clip(boxes(spark, (-88.3, 41.5, -88.2999, 41.5001)), boxes(spark, (-88.29995, 41.4, -88.29994, 41.6)))
    assert area(degrees) == pytest.approx(0.0001 * 0.0001 - 0.00001 * 0.0001, rel=1e-5)


def test_coverage_of_random_boxes(spark):
    rng = random.Random(11)
    def some(n):
        out = []
        for _ in range(n):
            x, y = rng.randrange(20), rng.randrange(20)
            out.append((x, y, x + rng.randrange(1, 7), y + rng.randrange(1, 7)))
        return out
    a, b = some(25), some(12)
    def held(items):
        return {(x, y) for x1, y1, x2, y2 in items for x in range(x1, x2) for y in range(y1, y2)}
    assert area(S.dissolve(boxes(spark, *a))) == pytest.approx(len(held(a)))
    assert area(S.clip(boxes(spark, *a), boxes(spark, *b))) == pytest.approx(len(held(a) - held(b)))


def test_open_boundaries_are_reported(spark):
    edges = [(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 1.0), (2.0, 1.0, 0.0, 1.0)]
    square = [(5.0, 0.0, 6.0, 0.0), (6.0, 0.0, 6.0, 1.0), (6.0, 1.0, 5.0, 1.0), (5.0, 1.0, 5.0, 0.0)]
    rings = S.assemble_rings(spark.createDataFrame(edges + square, "x1 double, y1 double, x2 double, y2 double"))
    got = rings.collect()
    assert [(r["area"], len(r["ring"])) for r in got if r["closed"]] == [(1.0, 5)]
    open_ = [r for r in got if not r["closed"]]
    assert open_ and all(r["area"] is None for r in open_) and sum(len(r["ring"]) for r in open_) == 3
    assert S.rings_to_shape(rings).count() == 1


def test_one_large_shape_among_small_ones(spark):
    small = boxes(spark, *[(3 * i, 3 * (i % 7), 3 * i + 1, 3 * (i % 7) + 1) for i in range(300)], key="p")
    large = boxes(spark, (-50000, -50000, 50000, 50000), (0, 0, 1, 1), key="q")
    got = {tuple(r) for r in S.intersects(small, "p", large, "q").collect()}
    assert got == {(i, 0) for i in range(300)} | {(0, 1)}
    rows = large.select("q", G.bounds(F.col("geom")).alias("b")).select("q", "b.*")
    cells = S._cells_by_level(rows.withColumn("own", S._level(F.col("x2") - F.col("x1"))), F.array(F.lit(0), F.lit(17)), *[F.col(c) for c in S.EDGE])
    assert cells.groupBy("q").count().agg(F.max("count")).first()[0] <= 8


def test_clip_area_adds_up(spark):
    rng = random.Random(21)
    base = polygons(spark, *[star(rng, 10, 10, 9, 12)])
    mask = polygons(spark, *[star(rng, rng.uniform(4, 16), rng.uniform(4, 16), 3, 6) for _ in range(8)])
    whole = area(S.dissolve(base))
    rest = area(S.clip(base, mask))
    both = area(S.overlay(base, mask, "union"))
    masks = area(S.dissolve(mask))
    # |A - B| = |A u B| - |B|
    assert rest == pytest.approx(both - masks, abs=1e-4)
    assert 0 < rest < whole


def test_rings(spark):
    shape = S.clip(boxes(spark, (0, 0, 6, 6), (10, 0, 12, 2)), boxes(spark, (1, 1, 2, 2), (3, 3, 4, 4), (11, 1, 13, 3)))
    rings = S.assemble_rings(shape)
    assert sorted(round(r["area"], 6) for r in rings.collect()) == [-1.0, -1.0, 3.0, 36.0]
    shapes = S.rings_to_shape(rings).select(G.area(F.col("geom")).alias("a"), F.size(F.col("geom")[0]).alias("n")).collect()
    assert sorted((round(r["a"], 6), r["n"]) for r in shapes) == [(3.0, 1), (34.0, 3)]


def test_long_ring(spark):
    n = 300
    ring = [(1000 * math.cos(2 * math.pi * i / n), 1000 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    out = S.assemble_rings(S.edges(polygons(spark, ring))).collect()
    assert len(out) == 1 and len(out[0]["ring"]) == n + 1
    assert out[0]["area"] == pytest.approx(n / 2 * 1e6 * math.sin(2 * math.pi / n))


def test_layer_files(spark, tmp_path):
    layer = S.set_crs(boxes(spark, (1_000_000, 1_800_000, 1_000_100, 1_800_100)), 3435)
    IO.write_layer_path(layer, str(tmp_path / "l"))
    degrees = IO.read_layer_path(spark, str(tmp_path / "l"), 4326).first()
    assert degrees["srid"] == 4326 and -89 < degrees["geom"][0][0][0]["x"] < -88
    home = IO.read_layer_path(spark, str(tmp_path / "l")).select(G.area(F.col("geom")).alias("a")).first()
    assert home["a"] == pytest.approx(10_000)


def test_curve_visits_every_cell_and_steps_to_a_neighbour(spark):
    cells = spark.range(1024).select((F.col("id") % 32).alias("x"), F.floor(F.col("id") / 32).alias("y"))
    rows = cells.select("x", "y", G.curve_place(F.col("x"), F.col("y"), 5).alias("place")).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1024))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:]))


def _scanned(df):
    """Rows that the file scan under a plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_region_reads_only_its_files(spark, tmp_path):
    rng = random.Random(3)
    spots = [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(4000)]
    layer = S.set_crs(boxes(spark, *[(x, y, x + 2, y + 3) for x, y in spots]), 3435)
    path = IO.write_layer_regions(layer, str(tmp_path / "r"), parts=64)
    part = IO.read_region(spark, path, (100, 200, 150, 260))
    want = {i for i, (x, y) in enumerate(spots) if x <= 150 and x + 2 >= 100 and y <= 260 and y + 3 >= 200}
    assert want and {r["id"] for r in part.select("id").collect()} == want
    plan = part.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(box_" in plan
    assert _scanned(part.select("id")) < 400
    # Stored anywhere else, the same filter reads everything.
    assert spark.read.parquet(path).count() == 4000
    degrees = IO.read_region(spark, path, (100, 200, 150, 260), 4326)
    assert degrees.count() == len(want) and degrees.first()["srid"] == 4326


def test_region_of_odd_layers(spark, tmp_path):
    same = boxes(spark, *[(5, 5, 6, 6)] * 50).unionByName(spark.createDataFrame([(-1, None), (-2, [])], f"id int, geom {G.GEOM}"))
    layer = S.set_crs(same, 3435).withColumns({"box_x1": F.lit("other"), "place": F.lit(1)})
    path = IO.write_layer_regions(layer, str(tmp_path / "same"), parts=4)
    got = IO.read_region(spark, path, (6, 6, 9, 9))
    assert got.count() == 50 and got.columns == ["id", "srid", "place", "geom"]
    assert IO.read_region(spark, path, (6.5, 6, 9, 9)).count() == 0
    assert IO.read_layer_path(spark, path).count() == 52
    for name, rows in (("none", layer.limit(0)), ("void", layer.filter("id < 0"))):
        IO.write_layer_regions(rows, str(tmp_path / name), source=3435)
        assert IO.read_region(spark, str(tmp_path / name), (0, 0, 9, 9)).count() == 0


def test_layer_table(spark):
    layer = S.set_crs(boxes(spark, (0, 0, 2, 2)), 3435)
    stored = IO.write_layer(layer, "boxes", "ref")
    IO.write_layer(layer, "boxes", "ref")
    assert stored.columns == ["geom_wkb", "srid"]
    assert IO.read_layer(spark, "boxes").select(G.area(F.col("geom")).alias("a")).first()["a"] == 4
    spark.sql("DROP DATABASE ref CASCADE")


def test_jurisdiction_boundary(spark):
    county = boxes(spark, (0, 0, 5280 * 3, 5280 * 3)).withColumns({"STATEFP": F.lit("17"), "COUNTYFP": F.lit("031")})
    mid = boxes(spark, (5280, 5280, 5280 * 2, 5280 * 2), (0, 0, 10, 10)).withColumn(
        "NAME", F.when(F.col("id") == 0, "Skokie").otherwise("Worth"))
    towns = boxes(spark, (0, 0, 5280, 5280)).withColumns({"NAME": F.lit("Stickney"), "COUNTYFP": F.lit("031")})
    out = L.jurisdiction_boundary(county, mid, towns, 3435).collect()
    assert len(out) == 1 and out[0]["area_sqmi"] == pytest.approx(7) and out[0]["srid"] == 3435


def test_layer_recipes(spark):
    shape = S.set_crs(boxes(spark, (0, 0, 5280, 5280)), 3435).drop("id")
    muni = shape.withColumns({"muni_name": F.lit("Worth"), "district": F.lit("OOJ"), "partial": F.lit(1), "exclude": F.lit(0)})
    places = shape.withColumns({"NAME": F.lit("Worth"), "GEOID": F.lit("17"), "ALAND": F.lit(27878400.0), "AWATER": F.lit(0.0)})
    row = L.municipalities(muni, places, 3435).first()
    assert (row["geoid_place"], row["location"], row["area_sqmi"]) == ("17", "SCC", 1.0)
    d = shape.withColumns({"district": F.lit("Outside"), "location": F.lit("chicago"), "sqmi": F.lit(0), "tracts": F.lit(4), "fips": F.lit("17031A")})
    assert L.districts_by_municipality(d).first()["district"] == "OOJ"
    t = L.districts_by_tract(d.drop("location", "fips").withColumn("district", F.lit("NORTH"))).first()
    assert (t["name_district"], t["num_tracts_2020"], round(t["area_sqmi"], 6)) == ("North", 4, 1.0)
    old = spark.createDataFrame([("17", "031", "A", "1.01", 2.5)], "STATE string, COUNTY string, TRACT string, NAME string, CENSUSAREA double")
    r = L.tracts_2010(d.drop("tracts"), old).first()
    assert (r["location"], r["area_sqmi"], r["name_district"]) == ("Chicago", 2.5, "OOJ")
    new = spark.createDataFrame([("17031A", "1.01", 27878400.0, 27878400.0)], "GEOID string, NAME string, ALAND double, AWATER double")
    r = L.tracts_2020(d.drop("tracts"), new).first()
    assert (r["area_land_sqmi"], r["area_sqmi"], r["name_tract_2020"]) == (1.0, 2.0, "1.01")
    z = shape.withColumns({"zcta": F.lit("60482"), "prmry_c": F.lit("Worth"), "prtl_pp": F.lit(0), "prcnt_d": F.lit(1.0), "notes": F.lit("")})
    us = spark.createDataFrame([("60482", 27878400.0, 0.0)], "GEOID20 string, ALAND20 double, AWATER20 double")
    assert L.zctas(z, us, 3435).first()["area_sqmi"] == 1.0


def test_turns_are_decided_as_written(spark):
    """Points a last digit beside a long line, with coordinates of eleven digits, against rational numbers."""
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        a = [Fraction(rng.randrange(10**10, 10**11), 10**4) for _ in range(2)]
        step = [Fraction(rng.randrange(-(10**6), 10**6), 10**4) for _ in range(2)]
        n, m = rng.randrange(2, 999), rng.randrange(1, 2000)
        b = [p + n * s for p, s in zip(a, step)]
        c = [p + m * s + Fraction(rng.choice([-1, 0, 0, 1]), 10**4) for p, s in zip(a, step)]
        rows.append((*a, *b, *c))
    want = [(q - p) * (w - r) - (s - r) * (v - p) for p, r, q, s, v, w in rows]
    names = "px double, py double, qx double, qy double, rx double, ry double"
    df = spark.createDataFrame([tuple(float(x) for x in row) for row in rows], names)
    exact = S._decimal(10.0**7)
    got = [r["s"] for r in df.select(S._side(*[F.col(n.split()[0]) for n in names.split(", ")], exact).alias("s")).collect()]
    assert got == [(w > 0) - (w < 0) for w in want]
    assert {0.0, 1.0, -1.0} == set(got)


def test_turns_of_any_size(spark):
    row = spark.range(1).select(
        S._side(*[F.lit(x) for x in (0.0, 0.0, 1e30, 1e30, 1e30, 2e30)], S._decimal(2e30)).alias("huge"),
        S._side(*[F.lit(x) for x in (0.1, 0.1, 0.3, 0.3, 0.7, 0.7)], S._decimal(0.7)).alias("line"),
    ).first()
    assert tuple(row) == (1.0, 0.0)


def test_long_edges_make_few_cells(spark):
    rows = [(0.0, 0.5, 100_000.0, 70_000.5)] + [(float(i), 0.0, i + 1.0, 0.3) for i in range(2000)]
    lines = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    mine, box = S._edge_box(lines, *S.EDGE)
    levels = mine.select("own").distinct().count()
    cells = S._cells_by_level(mine, S._levels(mine), *box).groupBy(*S.EDGE).count()
    assert cells.agg(F.max("count")).first()[0] <= 4 * levels


def test_long_and_short_edges_dissolve(spark):
    """A triangle of 100,000 ft whose slanted edge cuts a row of boxes of 1 ft."""
    wide = spark.createDataFrame([("POLYGON((0 0, 100000 0, 100000 50000, 0 0))",)], "w string").select(G.from_wkt(F.col("w")).alias("geom"))
    small = spark.range(0, 400, 2).select(G.box(F.col("id") * 1.0, F.lit(-0.5), F.col("id") + 1.0, F.lit(0.5)).alias("geom"))
    joined = S.dissolve(wide.unionByName(small))
    area = S.edge_area(joined).first()["area"]
    # A box adds its lower half; of the first, a quarter stands above the slanted line.
    assert area == pytest.approx(100_000 * 50_000 / 2 + 200 * 0.5 + 0.25, abs=1e-3)


def test_small_boxes_in_a_large_cell_do_not_meet_each_other(spark, monkeypatch):
    # 500 small boxes and one that holds them: the pairs that share a cell grow with the boxes, not with their square.
    met = []
    cells_by_level = S._cells_by_level

    def counted(*args):
        met.append(cells_by_level(*args))
        return met[-1]

    monkeypatch.setattr(S, "_cells_by_level", counted)
    boxes = [(i, 10.0 * i, 0.0, 10.0 * i + 4, 3.0) for i in range(500)] + [(500, -10.0, -10.0, 6000.0, 10.0)]
    layer = spark.createDataFrame(boxes, "l long, x1 double, y1 double, x2 double, y2 double")
    near = layer.select("l", G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("geom"))
    pairs = S.box_pairs(near, "l", near.withColumnRenamed("l", "r"), "r")
    assert pairs.count() == pairs.distinct().count() == 501 + 2 * 500
    shared = 0
    for large, small in zip(met[::2], met[1::2]):
        on = ["level", "cx", "cy"]
        shared += large.select(on).join(small.select(on), on).count()
    assert shared < 10 * len(boxes)


def test_the_meeting_of_edges_is_compiled(spark):
    # The virtual machine interprets methods of more than 8,000 bytes, which takes many times as long.
    lines = spark.createDataFrame([(float(i), 0.5, i + 1.0, i % 3 + 0.7) for i in range(50)], "x1 double, y1 double, x2 double, y2 double")
    mine, a = S._edge_box(lines, *S.EDGE)
    theirs, b = S._edge_box(S._other(lines), "u1", "v1", "u2", "v2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = S._meeting(mine, theirs, a, b).filter(S._edges_meet("decimal(17,13)"))
        stages = met._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000
    assert met.filter("x1 = u1 and y2 = v2").count() == 50

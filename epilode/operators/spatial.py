"""Layers of shapes: reprojection, intersection joins, dissolve, clip.

Shapes become rows of edges, and every test between shapes is an equi-join on
grid cells or strips followed by expressions, so the work is spread over the
cluster whatever the size of a single shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilode.functions import geometry as G
from epilode.functions.measures import SQFT_PER_SQMI
from epilode.session import cut_lineage

EDGE = ["x1", "y1", "x2", "y2"]


def set_crs(layer: DataFrame, srid: int) -> DataFrame:
    """Tag a layer with its reference system, coordinates unchanged."""
    return layer.withColumn("srid", F.lit(srid))


def reproject(layer: DataFrame, source: int, target: int, systems: dict | None = None) -> DataFrame:
    """Layer with its coordinates in another reference system."""
    if source == target:
        return set_crs(layer, target)
    moved = F.transform(
        "geom",
        lambda poly: F.transform(
            poly,
            lambda ring: F.transform(ring, lambda p: G.reproject_point(p["x"], p["y"], source, target, systems)),
        ),
    )
    return set_crs(layer.withColumn("geom", moved), target)


def add_area(layer: DataFrame, out: str = "area_sqmi", per: float = SQFT_PER_SQMI) -> DataFrame:
    """Shape area in square miles (coordinates in feet)."""
    return layer.withColumn(out, G.area(F.col("geom")) / F.lit(per))


def edges(layer: DataFrame, *keep: str) -> DataFrame:
    """One row per edge; outlines run counter-clockwise, holes clockwise.

    The inside of a shape is thus always to the left of its edges.
    """
    rings = layer.select(*keep, F.posexplode("geom").alias("poly", "rings")).select(
        *keep, F.posexplode("rings").alias("ring_no", "ring")
    )
    # Reverse a ring that runs the other way.
    ccw = G.ring_area(F.col("ring")) > 0
    turned = rings.withColumn(
        "ring", F.when(ccw == (F.col("ring_no") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    )
    pairs = F.transform(
        F.slice("ring", F.lit(1), F.size("ring") - 1),
        lambda p, i: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"),
            F.col("ring")[i + 1]["x"].alias("x2"), F.col("ring")[i + 1]["y"].alias("y2"),
        ),
    )
    # The outer form, so that the optimizer does not build the pairs twice to test them.
    return turned.select(*keep, F.explode_outer(pairs).alias("e")).select(*keep, "e.*").filter("x1 != x2 or y1 != y2")


def edge_area(boundary: DataFrame, *by: str) -> DataFrame:
    """Area enclosed by oriented edges, per group."""
    return boundary.groupBy(*by).agg(
        (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area")
    )


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _edges_by_cell(df: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float) -> DataFrame:
    """One row per grid cell that an edge passes (`cx`, `cy`).

    Column by column, so a long slanted edge takes as many cells as it is long
    and not all cells of its bounding box.
    """
    ax, ay, bx, by = (F.col(c) for c in (x1, y1, x2, y2))
    lo, hi = F.least(ax, bx), F.greatest(ax, bx)
    cols = df.withColumn("cx", F.explode(_cells(lo, hi, size)))
    left, right = F.greatest(lo, F.col("cx") * size), F.least(hi, (F.col("cx") + 1) * size)
    slope = F.try_divide(by - ay, bx - ax)
    ends = [F.coalesce(ay + (x - ax) * slope, ay) for x in (left, right)]
    # A vertical edge spans its whole height; rounding must not lose a cell.
    low = F.when(ax == bx, F.least(ay, by)).otherwise(F.least(*ends)) - size * 1e-9
    high = F.when(ax == bx, F.greatest(ay, by)).otherwise(F.greatest(*ends)) + size * 1e-9
    return cols.withColumn("cy", F.explode(_cells(low, high, size)))


def _edge_size(edge_rows: DataFrame) -> float:
    """Grid size for edges: twice their mean extent."""
    side = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    got = edge_rows.agg(F.avg(side).alias("s")).first()["s"]
    return 2.0 * got if got else 1.0


# Level of the finest grid; smaller extents count as this.
_FINEST = -20


def _level(extent: Column) -> Column:
    """Least power of two (its exponent) that an extent does not exceed."""
    return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(2.0**_FINEST)))), F.lit(_FINEST)).cast("int")


def _levels(rows: DataFrame) -> Column:
    """All levels that occur, as a scalar: as many as there are orders of magnitude."""
    return rows.agg(F.coalesce(F.collect_set("own"), F.array().cast("array<int>"))).scalar()


def _cells_by_level(rows: DataFrame, others: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """One row per cell that a box touches, at those of the given levels that are not below its `own`.

    A box is no wider than a cell of its own level, so it touches four at most.
    """
    at = rows.withColumn("others", others).withColumn("level", F.explode(F.filter("others", lambda v: v >= F.col("own")))).drop("others")
    size = F.pow(F.lit(2.0), F.col("level"))
    return at.withColumn("cx", F.explode(F.sequence(F.floor(x1 / size), F.floor(x2 / size)))).withColumn(
        "cy", F.explode(F.sequence(F.floor(y1 / size), F.floor(y2 / size)))
    )


def _meeting_smaller(left: DataFrame, right: DataFrame, a: list[Column], b: list[Column], equal: bool = True) -> DataFrame:
    """Rows of both sides whose boxes meet, where the level of the left is the coarser one, or `equal`.

    The left stands in the cells of its own level only, so that the many small boxes in a
    large cell meet the few large ones there and not each other.
    """
    large = _cells_by_level(left, F.array("own"), *a)
    small = _cells_by_level(right, _levels(left), *b).withColumnRenamed("own", "own_r")
    size = F.pow(F.lit(2.0), F.col("level"))
    return large.join(small if equal else small.filter("level > own_r"), ["level", "cx", "cy"]).filter(
        (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
        & (F.col("cx") == F.floor(F.greatest(a[0], b[0]) / size))
        & (F.col("cy") == F.floor(F.greatest(a[1], b[1]) / size))
    )


def _meeting(left: DataFrame, right: DataFrame, a: list[Column], b: list[Column]) -> DataFrame:
    """Rows of both sides whose boxes meet (touching counts), each pair once.

    `left` and `right` carry their level as `own`; `a` and `b` are the boxes.  Two boxes
    meet at the coarser of their levels, in the cell that holds the lower left corner of
    their overlap.
    """
    larger = _meeting_smaller(left, right, a, b).drop("own", "own_r")
    return larger.unionByName(_meeting_smaller(right, left, b, a, equal=False).drop("own", "own_r"))


def box_pairs(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
    """Pairs (l, r) whose bounding boxes meet (touching counts), each once."""
    def boxes(layer: DataFrame, key: str, name: str) -> DataFrame:
        rows = layer.select(F.col(key), G.bounds(F.col("geom")).alias("g")).select(
            F.col(key).alias(name), *[F.col(f"g.{c}").alias(f"{name}{c}") for c in EDGE]
        ).filter(F.col(f"{name}x1").isNotNull())
        extent = F.greatest(F.col(f"{name}x2") - F.col(f"{name}x1"), F.col(f"{name}y2") - F.col(f"{name}y1"))
        return rows.withColumn("own", _level(extent))

    sides = [[F.col(f"{n}{c}") for c in EDGE] for n in "lr"]
    return _meeting(boxes(left, left_id, "l"), boxes(right, right_id, "r"), *sides).select("l", "r")


# Significant digits of the numbers that decide a turn exactly.
_EXACT = 17


def _largest(*edge_tables: DataFrame) -> float:
    """The largest absolute coordinate of edges."""
    found = [t.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in t.columns if c in (*EDGE, "u1", "v1", "u2", "v2")])).alias("m")).first()["m"] for t in edge_tables]
    return max([m for m in found if m], default=1.0)


def _decimal(largest: float) -> str:
    """A type that holds coordinates up to the largest as they are written, and whose products are exact."""
    whole = max(1, math.floor(math.log10(largest)) + 2)
    return f"decimal({_EXACT},{max(0, _EXACT - whole)})"


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column, exact: str) -> Column:
    """Sign of the turn p -> q -> r, as the coordinates are written.

    A turn that floating point may have wrong (by the rounding of the coordinates, their
    differences and products) is decided by the signs of the differences, where the two
    products do not have the same sign, and otherwise by decimals, which take far longer.
    """
    ax, ay, bx, by = qx - px, ry - py, qy - py, rx - px
    turn = ax * ay - bx * by
    size = (
        (F.abs(qx) + F.abs(px)) * F.abs(ay) + (F.abs(ry) + F.abs(py)) * F.abs(ax)
        + (F.abs(qy) + F.abs(py)) * F.abs(by) + (F.abs(rx) + F.abs(px)) * F.abs(bx)
    )
    # Two numbers that differ by more than the last digit of the type differ as they are written.
    digit = 10.0 ** -int(exact.rstrip(")").split(",")[1])
    signs = [F.signum(d) for d in (ax, ay, bx, by)]
    ahead, behind = signs[0] * signs[1], signs[2] * signs[3]
    told = (ahead != behind) | (ahead == 0)
    for d in (ax, ay, bx, by):
        told = told & ((d == 0) | (F.abs(d) > 2 * digit))
    p_x, p_y, q_x, q_y, r_x, r_y = (c.try_cast(exact) for c in (px, py, qx, qy, rx, ry))
    left, right = (q_x - p_x) * (r_y - p_y), (q_y - p_y) * (r_x - p_x)
    sure = F.abs(turn) > size * 1e-15
    # Numbers beyond the type are left to floating point.
    return (
        F.when(sure, F.signum(turn)).when(told, F.signum(ahead - behind))
        .when(left > right, 1.0).when(left < right, -1.0).when(left == right, 0.0).otherwise(F.signum(turn))
    )


def _edges_meet(exact: str) -> Column:
    """Edge a (x1..y2) and edge b (u1..v2) share a point."""
    x1, y1, x2, y2, u1, v1, u2, v2 = (F.col(c) for c in (*EDGE, "u1", "v1", "u2", "v2"))
    overlap = (
        (F.least(x1, x2) <= F.greatest(u1, u2)) & (F.least(u1, u2) <= F.greatest(x1, x2))
        & (F.least(y1, y2) <= F.greatest(v1, v2)) & (F.least(v1, v2) <= F.greatest(y1, y2))
    )
    # Edges with an end in common need no turns, which are dear where they are close.
    shared = ((x1 == u1) & (y1 == v1)) | ((x1 == u2) & (y1 == v2)) | ((x2 == u1) & (y2 == v1)) | ((x2 == u2) & (y2 == v2))

    def crossed(e: Column) -> Column:
        x1, y1, x2, y2, u1, v1, u2, v2 = (e[n] for n in (*EDGE, "u1", "v1", "u2", "v2"))
        return (
            (_side(x1, y1, x2, y2, u1, v1, exact) * _side(x1, y1, x2, y2, u2, v2, exact) <= 0)
            & (_side(u1, v1, u2, v2, x1, y1, exact) * _side(u1, v1, u2, v2, x2, y2, exact) <= 0)
        )

    # A lambda, since the turns make one method out of the join that is too long to be compiled.
    return overlap & (shared | F.exists(F.array(F.struct(*EDGE, "u1", "v1", "u2", "v2")), crossed))


def _other(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.withColumnsRenamed({"x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})


def _edge_box(rows: DataFrame, x1: str, y1: str, x2: str, y2: str) -> tuple[DataFrame, list[Column]]:
    """Edges with their level, and their boxes."""
    low = [F.least(x1, x2), F.least(y1, y2)]
    high = [F.greatest(x1, x2), F.greatest(y1, y2)]
    return rows.withColumn("own", _level(F.greatest(high[0] - low[0], high[1] - low[1]))), [*low, *high]


def inside(probes: DataFrame, ids: list[str], shapes: DataFrame, key: str) -> DataFrame:
    """(*ids) of the probe points (*ids, key, px, py) that lie inside their shape `key`.

    shapes(key, u1, v1, u2, v2) are edges.  An edge stands in the strips of its own height
    that it touches, two at most; a probe looks into its strip at each height.
    """
    c = F.col
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    leveled = shapes.filter("v1 != v2").withColumn("own", _level(high - low))
    size = F.pow(F.lit(2.0), c("own"))
    strips = leveled.withColumn("strip", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    at = probes.withColumn("own", _levels(leveled)).withColumn("own", F.explode("own")).withColumn("strip", F.floor(c("py") / F.pow(F.lit(2.0), c("own"))))
    up, down = (c("v1") <= c("py")) & (c("v2") > c("py")), (c("v2") <= c("py")) & (c("v1") > c("py"))
    crossing = c("u1") + (c("py") - c("v1")) * (c("u2") - c("u1")) / (c("v2") - c("v1"))
    met = at.join(strips, [key, "own", "strip"]).filter((up | down) & (crossing > c("px")))
    return met.groupBy(*ids).agg(F.sum(F.when(up, 1).otherwise(-1)).alias("w")).filter("w != 0").select(*ids)


def intersects(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
    """(left id, right id) of shapes that share a point, each pair once.

    Either two edges meet, or one shape lies inside the other, which one of its
    points tells.  Only shapes whose boxes meet are looked at more closely.  Shapes and
    edges stand in a grid of about their own size, so a large one among small ones makes
    no more cells than any other.
    """
    pairs = cut_lineage(box_pairs(left, left_id, right, right_id), "box_pairs")
    near = {n: cut_lineage(pairs.select(n).distinct(), "near_shapes") for n in "lr"}
    le = left.withColumnRenamed(left_id, "l").join(near["l"], "l", "left_semi")
    re = right.withColumnRenamed(right_id, "r").join(near["r"], "r", "left_semi")
    le, re = cut_lineage(edges(le, "l"), "left_edges"), _other(cut_lineage(edges(re, "r"), "right_edges"))
    lb, a = _edge_box(le, *EDGE)
    rb, b = _edge_box(re, "u1", "v1", "u2", "v2")
    exact = _decimal(_largest(le, re))
    crossing = cut_lineage(_meeting(lb, rb, a, b).filter(_edges_meet(exact)).select("l", "r").distinct(), "crossing")
    open_ = pairs.join(crossing, ["l", "r"], "left_anti")
    lp = left.select(F.col(left_id).alias("l"), F.col("geom")[0][0][0].alias("p"))
    rp = right.select(F.col(right_id).alias("r"), F.col("geom")[0][0][0].alias("p"))
    # A point of one shape is looked up in the other, both ways at once.
    left_key, right_key = (F.struct(F.lit(s).alias("s"), F.col(s).cast("string").alias("i")) for s in "lr")
    probes = open_.join(lp, "l").select("l", "r", right_key.alias("shape"), "p").unionByName(
        open_.join(rp, "r").select("l", "r", left_key.alias("shape"), "p")
    )
    corners = ["u1", "v1", "u2", "v2"]
    shapes = _other(le).select(left_key.alias("shape"), *corners).unionByName(
        re.select(right_key.alias("shape"), *corners)
    )
    points = probes.select("l", "r", "shape", F.col("p")["x"].alias("px"), F.col("p")["y"].alias("py"))
    inner = inside(points, ["l", "r", "shape"], shapes, "shape").select("l", "r").distinct()
    return crossing.unionByName(inner).select(F.col("l").alias(left_id), F.col("r").alias(right_id))


# Cells of a grid row that are summed together before rows are.
_BLOCK = 1024


# ---- overlay -----------------------------------------------------------------


def cancel_shared(boundary: DataFrame) -> DataFrame:
    """Boundary of a noded coverage: edges used twice in opposite directions go.

    Neighbours in a noded coverage share whole edges, once in each direction.
    """
    net = _forward(boundary).groupBy(*EDGE).agg(F.sum("d").alias("d")).filter("d != 0")
    turn = F.col("d") < 0
    return net.select(
        F.when(turn, F.col("x2")).otherwise(F.col("x1")).alias("x1"),
        F.when(turn, F.col("y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(turn, F.col("x1")).otherwise(F.col("x2")).alias("x2"),
        F.when(turn, F.col("y1")).otherwise(F.col("y2")).alias("y2"),
    )


def _forward(boundary: DataFrame, *keep: Column) -> DataFrame:
    """Edges from their smaller to their larger end, with `d` = 1, or -1 for those that were turned."""
    straight = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = (("x1", "x2", "x1"), ("y1", "y2", "y1"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))
    return boundary.select(
        *[F.when(straight, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in ends],
        F.when(straight, 1).otherwise(-1).alias("d"), *keep,
    )


def _resolution(boundary: DataFrame) -> int:
    """Digits to which coordinates are kept: eleven significant ones of the largest.

    Relative to the layer, so degrees and feet are treated alike.
    """
    return 11 - math.ceil(math.log10(_largest(boundary)))


def _pieces(all_edges: DataFrame, weights: list[str]) -> DataFrame:
    """Undirected pieces of edges that meet others only at their ends.

    Edges meet at the coarser of their levels, so a long one among short ones, or a dense
    place in a wide layer, takes four cells a level at most.

    `weights` are columns of `all_edges`; a piece carries, for each, their sum over the
    edges that run along it forwards, less those that run backwards.
    """
    largest = _largest(all_edges)
    digits, exact = 11 - math.ceil(math.log10(largest)), _decimal(largest)
    kept = [F.col(w) for w in weights]
    rounded = all_edges.select(*[F.round(c, digits).alias(c) for c in EDGE], *kept).filter("x1 != x2 or y1 != y2")
    sums = [F.sum(F.col("d") * F.col(w)).alias(w) for w in weights]
    lines = cut_lineage(_forward(rounded, *kept).groupBy(*EDGE).agg(*sums), "lines")
    mine, a = _edge_box(lines.select(*EDGE), *EDGE)
    theirs, b = _edge_box(_other(lines.select(*EDGE)), "u1", "v1", "u2", "v2")
    c = F.col
    same = (c("x1") == c("u1")) & (c("y1") == c("v1")) & (c("x2") == c("u2")) & (c("y2") == c("v2"))
    # Both sides are the same edges: each pair is met from its larger one, and then told to both.
    half = _meeting_smaller(mine, theirs, a, b).filter(~same & _edges_meet(exact))
    corners = ["u1", "v1", "u2", "v2"]
    told = F.array_compact(F.array(
        F.struct(*EDGE, *corners),
        F.when(c("own") > c("own_r"), F.struct(*[c(y).alias(x) for x, y in zip(EDGE + corners, corners + EDGE)])),
    ))
    met = half.select(F.explode(told).alias("m")).select("m.*")
    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("u2") - c("u1"), c("v2") - c("v1")
    den = dx * ey - dy * ex
    length2 = dx * dx + dy * dy

    def along(px: Column, py: Column) -> Column:
        return ((px - c("x1")) * dx + (py - c("y1")) * dy) / length2

    # Parallel edges that meet overlap: cut at the other's ends.
    cuts = F.when(den == 0, F.array(along(c("u1"), c("v1")), along(c("u2"), c("v2")))).otherwise(
        F.array(F.try_divide((c("u1") - c("x1")) * ey - (c("v1") - c("y1")) * ex, den))
    )
    points = met.select(*EDGE, F.explode(cuts).alias("t")).filter("t > 0 and t < 1").groupBy(*EDGE).agg(
        F.collect_set("t").alias("ts")
    )
    whole = lines.join(points, EDGE, "left").withColumn(
        "ts", F.array_sort(F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    )

    def at(t: Column) -> Column:
        exact = F.when(t == 0, F.struct(c("x1").alias("x"), c("y1").alias("y"))).when(
            t == 1, F.struct(c("x2").alias("x"), c("y2").alias("y"))
        )
        return exact.otherwise(
            F.struct(F.round(c("x1") + t * dx, digits).alias("x"), F.round(c("y1") + t * dy, digits).alias("y"))
        )

    pieces = F.transform(
        F.slice("ts", F.lit(1), F.size("ts") - 1),
        lambda t, i: F.struct(at(t).alias("s"), at(c("ts")[i + 1]).alias("e")),
    )
    cut = whole.select(F.explode_outer(pieces).alias("p"), *kept).select(
        c("p.s.x").alias("x1"), c("p.s.y").alias("y1"), c("p.e.x").alias("x2"), c("p.e.y").alias("y2"), *kept
    ).filter("x1 != x2 or y1 != y2")
    return _forward(cut, *kept).groupBy(*EDGE).agg(*sums)


def _below(pieces: DataFrame, weights: list[str], size: float) -> DataFrame:
    """(id, *weights): how often the arrangement winds around the place just below each probed piece.

    pieces(id, probed, x1 <= x2, ..., *weights).  The place is the middle of the piece,
    reached from the base line of its grid row straight upwards, without the piece itself:
    no distance beside it is needed.  The winding number on the base line comes from
    running sums over the row's cells, and what lies between it and the piece corrects it.
    """
    c = F.col
    at_cell = pieces.filter("probed").select(
        "id", ((c("x1") + c("x2")) / 2).alias("px"), ((c("y1") + c("y2")) / 2).alias("py")
    ).withColumns({"cx": F.floor(c("px") / size), "cy": F.ceil(c("py") / size) - 1})  # the line lies below the place
    rows = _other(pieces.withColumnRenamed("id", "other").drop("probed"))
    low, high = F.ceil(F.least("v1", "v2") / size), F.floor(F.greatest("v1", "v2") / size)
    line = c("cy") * size
    up, down = (c("v1") <= line) & (c("v2") > line), (c("v2") <= line) & (c("v1") > line)
    crossings = (
        rows.filter((c("v1") != c("v2")) & (low <= high))
        .withColumn("cy", F.explode(F.sequence(low, high)))
        .withColumn("sign", F.when(up, 1).when(down, -1).otherwise(0))
        .filter("sign != 0")
        .withColumn("at", c("u1") + (line - c("v1")) * (c("u2") - c("u1")) / (c("v2") - c("v1")))
        .withColumn("cx", F.floor(c("at") / size))
        .select("cx", "cy", "at", *[(c("sign") * c(w)).alias(w) for w in weights])
    )
    cells = (
        crossings.select("cx", "cy", *weights)
        .unionByName(at_cell.select("cx", "cy").distinct().withColumns({w: F.lit(0).cast("bigint") for w in weights}))
        .groupBy("cy", "cx")
        .agg(*[F.sum(w).alias(w) for w in weights])
        .withColumn("block", F.floor(c("cx") / _BLOCK))
    )
    right = Window.partitionBy("cy", "block").orderBy(c("cx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("cy").orderBy(c("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("cy", "block").agg(*[F.sum(w).alias(w) for w in weights]).select(
        "cy", "block", *[F.sum(w).over(later).alias(f"beyond_{w}") for w in weights]
    )
    zero = F.lit(0)
    base = cells.withColumns({f"within_{w}": F.sum(w).over(right) for w in weights}).join(blocks, ["cy", "block"]).select(
        "cx", "cy", *[(F.coalesce(f"within_{w}", zero) + F.coalesce(f"beyond_{w}", zero)).alias(w) for w in weights]
    )
    on_cell = ["cx", "cy"]
    on_line = at_cell.join(crossings, on_cell).filter(c("at") > c("px"))
    # Going up from the base line: an edge that runs to the right adds one.
    height = c("v1") + (c("px") - c("u1")) * (c("v2") - c("v1")) / (c("u2") - c("u1"))
    local = _edges_by_cell(rows.filter("u1 != u2"), "u1", "v1", "u2", "v2", size)
    above = (
        at_cell.join(local, on_cell)
        .filter((c("other") != c("id")) & (c("u1") <= c("px")) & (c("u2") > c("px")))
        .withColumn("height", height)
        .filter((c("height") > c("cy") * size) & (c("height") <= c("py")))
    )
    parts = at_cell.join(base, on_cell).select("id", *weights)
    for more in (on_line, above):
        parts = parts.unionByName(more.select("id", *weights))
    return parts.groupBy("id").agg(*[F.sum(w).alias(w) for w in weights])


def _sides(pieces: DataFrame, weights: list[str], size: float) -> DataFrame:
    """Pieces with `<w>_left` and `<w>_right`: how often each side is wound around.

    Flat pieces are looked at from below; for steep ones the axes change places, which
    also turns the sign of every winding.
    """
    c = F.col
    steep = F.abs(c("y2") - c("y1")) > c("x2") - c("x1")
    numbered = cut_lineage(pieces.withColumns({"id": F.monotonically_increasing_id(), "steep": steep}), "pieces")
    flat = _below(numbered.withColumn("probed", ~c("steep")).drop("steep"), weights, size)
    # Mirrored at the diagonal; an edge is turned where it runs the other way then.
    turned = c("y1") > c("y2")
    swapped = numbered.select(
        "id", c("steep").alias("probed"),
        F.when(turned, c("y2")).otherwise(c("y1")).alias("x1"), F.when(turned, c("x2")).otherwise(c("x1")).alias("y1"),
        F.when(turned, c("y1")).otherwise(c("y2")).alias("x2"), F.when(turned, c("x1")).otherwise(c("x2")).alias("y2"),
        *[F.when(turned, -c(w)).otherwise(c(w)).alias(w) for w in weights],
    )
    upright = _below(swapped, weights, size)

    def renamed(found: DataFrame) -> DataFrame:
        return found.select("id", *[c(w).alias(f"at_{w}") for w in weights])

    out = {}
    for w in weights:
        # Forwards, left of a flat piece is above it; a steep one may run down.
        out[f"{w}_left"] = F.when(~c("steep"), c(f"at_{w}") + c(w)).when(turned, -(c(f"at_{w}") - c(w))).otherwise(-c(f"at_{w}"))
        out[f"{w}_right"] = F.when(~c("steep"), c(f"at_{w}")).when(turned, -c(f"at_{w}")).otherwise(-(c(f"at_{w}") + c(w)))
    return numbered.join(renamed(flat).unionByName(renamed(upright)), "id").withColumns(out)


def overlay(a: DataFrame, b: DataFrame | None = None, how: str = "union", size: float | None = None) -> DataFrame:
    """Boundary edges of the union of layer `a`, or of `a` minus layer `b`.

    Works for overlapping and for unaligned shapes: edges are cut where they meet, and a
    piece belongs to the boundary if the result covers exactly one of its sides.
    Coordinates are kept to eleven significant digits of the largest one; nothing wider
    than that is lost.
    """
    weights = ["a"] if b is None else ["a", "b"]
    rows = None
    for name, layer in zip(weights, (a, b)):
        part = edges(layer).select(*EDGE, *[F.lit(int(w == name)).cast("bigint").alias(w) for w in weights])
        rows = part if rows is None else rows.unionByName(part)
    rows = cut_lineage(rows, "edges")
    # Where edges of a layer cancel each other, nothing changes from side to side.
    pieces = _pieces(rows, weights).filter(" or ".join(f"{w} != 0" for w in weights))
    pieces = cut_lineage(pieces, "pieces")
    sides = _sides(pieces, weights, size or _edge_size(pieces))

    def holds(side: str) -> Column:
        covered = F.col(f"a_{side}") != 0
        if how == "difference":
            covered = covered & (F.col(f"b_{side}") == 0)
        elif b is not None:
            covered = covered | (F.col(f"b_{side}") != 0)
        return covered

    kept = sides.select(*EDGE, holds("left").alias("l"), holds("right").alias("r")).filter("l != r")
    return kept.select(
        *[F.when(F.col("l"), F.col(x)).otherwise(F.col(y)).alias(n)
          for x, y, n in (("x1", "x2", "x1"), ("y1", "y2", "y1"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))]
    )


def dissolve(layer: DataFrame, noded: bool = False, **options) -> DataFrame:
    """Boundary edges of all shapes merged; `noded` skips the cutting."""
    return cancel_shared(edges(layer)) if noded else overlay(layer, None, "union", **options)


def clip(layer: DataFrame, mask: DataFrame, noded: bool = False, **options) -> DataFrame:
    """Boundary edges of `layer` minus `mask`.

    `noded` requires a mask inside the layer whose edges match the layer's
    where they run together.
    """
    if not noded:
        return overlay(layer, mask, "difference", **options)
    cut = cancel_shared(edges(mask)).select(
        F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")
    )
    return cancel_shared(edges(layer).select(*EDGE).unionByName(cut))


def is_noded(layer: DataFrame) -> bool:
    """No edge of the layer is met by another between its ends."""
    lines = edges(layer).select(*EDGE, F.lit(1).cast("bigint").alias("n"))
    pieces = _pieces(lines, ["n"]).select(*EDGE)
    digits = _resolution(lines)
    whole = _forward(lines.select(*[F.round(c, digits).alias(c) for c in EDGE])).select(*EDGE).distinct()
    return whole.join(pieces, EDGE, "left_anti").limit(1).count() == 0


def assemble_rings(boundary: DataFrame) -> DataFrame:
    """Rings of a boundary: (ring_id, ring, area, closed).

    Edges that do not close come back as a row with `closed` false, their points without
    the first one repeated, and no area.

    Each edge points to the one that continues it (the sharpest left turn where
    several do).  Doubling those pointers finds the first edge of every ring and
    each edge's distance to it in as many rounds as the ring length has bits.
    """
    angle = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    rows = cut_lineage(
        boundary.select(*EDGE).distinct().withColumn("id", F.concat_ws(",", *EDGE)).withColumn("dir", angle), "ring_edges"
    )
    after = rows.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"),
                        F.col("dir").alias("ndir"))
    # A turn measured from the reversed incoming direction, clockwise.
    turn = F.pmod(F.col("dir") + F.lit(3.141592653589793) - F.col("ndir"), F.lit(2 * 3.141592653589793))
    # An edge that nothing continues points to itself.
    link = rows.join(after, ["x2", "y2"], "left").groupBy("id").agg(
        F.min_by("next", F.struct(F.when(turn < 1e-12, 7.0).otherwise(turn), "next")).alias("next")
    ).withColumn("next", F.coalesce("next", "id"))
    state = cut_lineage(
        link.select("id", "next", F.col("id").alias("head"), F.lit(0).cast("bigint").alias("hops"),
                    F.lit(1).cast("bigint").alias("step")),
        "ring_links",
    )
    while True:
        # head = least of the `step` edges from here on, hops = distance to it
        far = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("head").alias("head2"),
                           F.col("hops").alias("hops2"))
        joined = state.join(far, "next")
        better = F.col("head2") < F.col("head")
        new = cut_lineage(
            joined.select(
                "id", F.col("next2").alias("next"), F.least("head", "head2").alias("head"),
                F.when(better, F.col("step") + F.col("hops2")).otherwise(F.col("hops")).alias("hops"),
                (F.col("step") * 2).alias("step"),
                better.alias("changed"),
            ),
            "ring_links",
        )
        done = new.filter("changed").limit(1).count() == 0
        state = new.drop("changed")
        if done:
            break
    placed = rows.join(state.select("id", "head", "hops"), "id")
    # hops counts down to the head: the farthest edge comes right after it.
    order = F.struct((-F.when(F.col("id") == F.col("head"), F.lit(1 << 60)).otherwise(F.col("hops"))).alias("o"),
                     F.col("x1").alias("x"), F.col("y1").alias("y"))
    # A closed ring starts from the same points that it ends in.
    starts, ends = (F.sum(F.xxhash64(*p).cast("decimal(38,0)")) for p in (("x1", "y1"), ("x2", "y2")))
    rings = placed.groupBy("head").agg(F.array_sort(F.collect_list(order)).alias("pts"), (starts == ends).alias("closed"))
    pts = F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    ring = F.when(F.col("closed"), F.concat(pts, F.slice(pts, 1, 1))).otherwise(pts)
    whole = rings.select("head", ring.alias("ring"), "closed")
    area = F.when(F.col("closed"), G.ring_area(F.col("ring")))
    return whole.select(F.col("head").alias("ring_id"), "ring", area.alias("area"), "closed")


def rings_to_shape(rings: DataFrame) -> DataFrame:
    """Polygons of the closed rings: (ring_id, geom), holes given to the outline around them."""
    rings = cut_lineage(rings, "rings")  # read once for each use below
    outer = rings.filter("area > 0").select("ring_id", "area", F.array(F.array("ring")).alias("geom"))
    holes = rings.filter("area < 0").select(F.col("ring_id").alias("hole_id"), F.array(F.array("ring")).alias("geom"))
    pairs = box_pairs(holes, "hole_id", outer, "ring_id")
    spot = F.col("geom")[0][0][0]
    probes = pairs.join(holes.select(F.col("hole_id").alias("l"), spot["x"].alias("px"), spot["y"].alias("py")), "l")
    outlines = _other(edges(outer.withColumnRenamed("ring_id", "r"), "r"))
    within = inside(probes, ["l", "r"], outlines, "r")
    owner = within.join(outer.select(F.col("ring_id").alias("r"), "area"), "r").groupBy("l").agg(
        F.min_by("r", F.struct("area", "r")).alias("ring_id")
    )
    owned = owner.join(holes, F.col("l") == F.col("hole_id")).groupBy("ring_id").agg(
        F.array_sort(F.collect_list(F.struct("hole_id", F.col("geom")[0][0].alias("ring")))).alias("hs")
    ).select("ring_id", F.transform("hs", lambda h: h["ring"]).alias("hs"))
    return outer.join(owned, "ring_id", "left").select(
        "ring_id",
        F.array(F.concat(F.col("geom")[0], F.coalesce("hs", F.array().cast(f"array<{G.RING}>")))).alias("geom"),
    )

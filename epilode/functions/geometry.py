"""Geometry as Column expressions.

A shape is `geom`: polygons > rings > points, the first ring of a polygon its
outline, the others holes, every ring closed.  WKT and areas are built-in
expressions; WKB holds raw bytes and takes an Arrow UDF over the nested lists.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
GEOM = f"array<array<{RING}>>"


def ring(*corners: tuple[Column, Column]) -> Column:
    """Closed ring through some corners."""
    points = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]
    return F.array(*points, points[0])


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Axis-parallel rectangle, counter-clockwise."""
    return F.array(F.array(ring((x1, y1), (x2, y1), (x2, y2), (x1, y2))))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, positive when counter-clockwise."""
    first = ring[0]
    # Coordinates relative to the first point keep the products small.
    steps = F.transform(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        lambda p, i: (p["x"] - first["x"]) * (ring[i + 1]["y"] - first["y"])
        - (ring[i + 1]["x"] - first["x"]) * (p["y"] - first["y"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / 2


def area(geom: Column) -> Column:
    """Area of a shape: outlines minus holes."""
    per_polygon = F.transform(
        geom,
        lambda rings: F.aggregate(
            F.transform(rings, lambda r, i: F.abs(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)),
            F.lit(0.0), lambda s, v: s + v,
        ),
    )
    return F.aggregate(per_polygon, F.lit(0.0), lambda s, v: s + v)


def points(geom: Column) -> Column:
    """All points of a shape in one array."""
    return F.flatten(F.flatten(geom))


def bounds(geom: Column) -> Column:
    """Struct x1, y1, x2, y2 around a shape."""
    xs = F.transform(points(geom), lambda p: p["x"])
    ys = F.transform(points(geom), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
    )


def curve_place(x: Column, y: Column, bits: int = 16) -> Column:
    """Place of a cell (whole numbers below 2^bits) along Hilbert's curve through a square of 2^bits cells a side.

    Cells that are close along the curve are close in the square.
    """
    far = F.lit((1 << bits) - 1).cast("bigint")
    start = F.struct(
        x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("place")
    )

    def quarter(at: Column, side: Column) -> Column:
        right, top = at["x"].bitwiseAND(side) != 0, at["y"].bitwiseAND(side) != 0
        before = F.when(right & top, 2).when(right, 3).when(top, 1).otherwise(0)
        # The curve runs transposed in the lower quarters, and backwards in the right one.
        across = F.when(top, at["x"]).when(right, far - at["y"]).otherwise(at["y"])
        up = F.when(top, at["y"]).when(right, far - at["x"]).otherwise(at["x"])
        return F.struct(across.alias("x"), up.alias("y"), (at["place"] + side * side * before).alias("place"))

    sides = F.array(*[F.lit(1 << k).cast("bigint") for k in reversed(range(bits))])
    return F.aggregate(sides, start, quarter)["place"]


def to_wkt(geom: Column) -> Column:
    """MULTIPOLYGON text."""
    def wrap(parts: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))

    return F.concat(
        F.lit("MULTIPOLYGON "),
        wrap(F.transform(geom, lambda poly: wrap(F.transform(poly, lambda ring: wrap(
            F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
        ))))),
    )


def from_wkt(text: Column) -> Column:
    """POLYGON or MULTIPOLYGON text to a shape."""
    body = F.regexp_replace(text, r"(?i)^\s*(MULTI)?POLYGON\s*", "")
    # Points and parentheses rewritten as JSON arrays.
    pairs = F.regexp_replace(body, r"([-+\d.eE]+)\s+([-+\d.eE]+)", '{"x":$1,"y":$2}')
    json = F.translate(pairs, "()", "[]")
    nested = F.when(F.upper(F.ltrim(text)).startswith("MULTI"), json).otherwise(
        F.concat(F.lit("["), json, F.lit("]"))
    )
    return F.from_json(nested, GEOM)


# Bits of a type word that announce a reference system, a height or a measure.
_EXTENDED = 0x20000000 | 0x40000000 | 0x80000000


def _packed(shapes: pa.ListArray) -> list[bytes | None]:
    """Multipolygons as bytes, from nested Arrow lists: the coordinates are copied as they lie."""
    polygons = shapes.values
    rings = polygons.values
    points = rings.values
    flat = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]).astype("<f8")
    outer, middle, inner = (x.offsets.to_numpy() for x in (shapes, polygons, rings))
    out = []
    for n, known in enumerate(shapes.is_valid().to_pylist()):
        if not known:
            out.append(None)
            continue
        parts = [struct.pack("<BII", 1, 6, outer[n + 1] - outer[n])]
        for p in range(outer[n], outer[n + 1]):
            parts.append(struct.pack("<BII", 1, 3, middle[p + 1] - middle[p]))
            for r in range(middle[p], middle[p + 1]):
                parts += [struct.pack("<I", inner[r + 1] - inner[r]), flat[inner[r] : inner[r + 1]].tobytes()]
        out.append(b"".join(parts))
    return out


def _read(data: bytes) -> list[list[np.ndarray]]:
    """Polygons of rings of coordinate pairs."""

    def header(at: int) -> tuple[str, int, int, int]:
        order = "<" if data[at] == 1 else ">"
        kind, count = struct.unpack_from(order + "II", data, at + 1)
        if kind & _EXTENDED or kind not in (3, 6):
            raise ValueError(f"shape type {kind:#x} is no plain polygon or multipolygon")
        return order, kind, count, at + 9

    def polygon(at: int) -> tuple[list[np.ndarray], int]:
        order, kind, count, at = header(at)
        rings = []
        for _ in range(count):
            (n,) = struct.unpack_from(order + "I", data, at)
            rings.append(np.frombuffer(data, f"{order}f8", 2 * n, at + 4).reshape(n, 2))
            at += 4 + 16 * n
        return rings, at

    _, kind, count, at = header(0)
    if kind == 3:
        return [polygon(0)[0]]
    out = []
    for _ in range(count):
        rings, at = polygon(at)
        out.append(rings)
    return out


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _unpacked(column: pa.Array) -> pa.Array:
    shapes = [None if b is None else _read(b) for b in column.to_pylist()]
    polygons = [p for s in shapes if s for p in s]
    rings = [r for p in polygons for r in p]
    flat = np.concatenate(rings).astype(np.float64) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in (0, 1)], names=["x", "y"])
    inner = pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), points)
    middle = pa.ListArray.from_arrays(_offsets([len(p) for p in polygons]), inner)
    missing = pa.array([s is None for s in shapes], pa.bool_())
    return pa.ListArray.from_arrays(_offsets([len(s or []) for s in shapes]), middle, mask=missing)


@F.arrow_udf(T.BinaryType())
def _to_wkb(shapes: pa.Array) -> pa.Array:
    return pa.array(_packed(shapes), pa.binary())


_GEOM_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
)))


@F.arrow_udf(_GEOM_TYPE)
def _from_wkb(data: pa.Array) -> pa.Array:
    return _unpacked(data)


def to_wkb(geom: Column) -> Column:
    """Well-known binary (multipolygon, little endian)."""
    return _to_wkb(geom)


def from_wkb(data: Column) -> Column:
    """Shape of a polygon or multipolygon in well-known binary.

    Types with a reference system, heights or measures are refused, not misread.
    """
    return _from_wkb(data)


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator system; lengths in metres, `unit` metres per unit."""

    lat0: float
    lon0: float
    scale: float
    false_east: float
    false_north: float
    unit: float = 1.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101

    def series(self) -> dict:
        """Constants of the sixth-order series in the third flattening."""
        f = 1 / self.inverse_flattening
        n = f / (2 - f)
        radius = self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
        alpha = [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ]
        beta = [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ]
        ecc = math.sqrt(f * (2 - f))
        chi0 = self._conformal(math.radians(self.lat0), ecc)
        xi0 = chi0 + sum(a * math.sin(2 * (j + 1) * chi0) for j, a in enumerate(alpha))
        return {"radius": radius, "alpha": alpha, "beta": beta, "ecc": ecc, "north0": self.scale * radius * xi0}

    @staticmethod
    def _conformal(phi: float, ecc: float) -> float:
        return math.atan(math.sinh(math.asinh(math.tan(phi)) - ecc * math.atanh(ecc * math.sin(phi))))


# The state-plane system (US survey feet) and geographic degrees.
SYSTEMS: dict[int, TransverseMercator | None] = {
    3435: TransverseMercator(
        lat0=36 + 2 / 3, lon0=-(88 + 1 / 3), scale=0.999975, false_east=300000.0, false_north=0.0,
        unit=1200 / 3937,
    ),
    4326: None,
}


def _bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once (lambdas share no subexpressions)."""
    return F.transform(F.array(value), body)[0]


def _forward(lon: Column, lat: Column, tm: TransverseMercator) -> Column:
    c = tm.series()
    k = tm.scale * c["radius"]
    phi, lam = F.radians(lat), F.radians(lon - tm.lon0)
    t = F.sinh(F.asinh(F.tan(phi)) - c["ecc"] * F.atanh(c["ecc"] * F.sin(phi)))

    def spherical(v: Column) -> Column:
        return F.struct(
            F.atan2(v["t"], F.cos(v["lam"])).alias("xi"),
            F.asinh(F.sin(v["lam"]) / F.sqrt(v["t"] * v["t"] + F.cos(v["lam"]) * F.cos(v["lam"]))).alias("eta"),
        )

    def plane(z: Column) -> Column:
        xi, eta = z["xi"], z["eta"]
        east, north = eta, xi
        for j, a in enumerate(c["alpha"], 1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct(
            ((k * east + tm.false_east) / tm.unit).alias("x"),
            ((k * north - c["north0"] + tm.false_north) / tm.unit).alias("y"),
        )

    return _bind(F.struct(t.alias("t"), lam.alias("lam")), lambda v: _bind(spherical(v), plane))


def _inverse(x: Column, y: Column, tm: TransverseMercator) -> Column:
    c = tm.series()
    k = tm.scale * c["radius"]
    xi = (y * tm.unit - tm.false_north + c["north0"]) / k
    eta = (x * tm.unit - tm.false_east) / k

    def spherical(z: Column) -> Column:
        xi1, eta1 = z["xi"], z["eta"]
        for j, b in enumerate(c["beta"], 1):
            xi1 = xi1 - b * F.sin(2 * j * z["xi"]) * F.cosh(2 * j * z["eta"])
            eta1 = eta1 - b * F.cos(2 * j * z["xi"]) * F.sinh(2 * j * z["eta"])
        return F.struct(xi1.alias("xi"), eta1.alias("eta"))

    def geographic(v: Column) -> Column:
        # From conformal to geographic latitude; each step gains about five digits.
        phi = F.atan(F.sinh(v["target"]))
        for _ in range(6):
            phi = F.atan(F.sinh(v["target"] + c["ecc"] * F.atanh(c["ecc"] * F.sin(phi))))
        return F.struct((F.degrees(v["lam"]) + tm.lon0).alias("x"), F.degrees(phi).alias("y"))

    def angles(z: Column) -> Column:
        chi = F.asin(F.sin(z["xi"]) / F.cosh(z["eta"]))
        return F.struct(
            F.asinh(F.tan(chi)).alias("target"), F.atan2(F.sinh(z["eta"]), F.cos(z["xi"])).alias("lam")
        )

    start = F.struct(xi.alias("xi"), eta.alias("eta"))
    return _bind(start, lambda s: _bind(spherical(s), lambda z: _bind(angles(z), geographic)))


def reproject_point(x: Column, y: Column, source: int, target: int, systems: dict | None = None) -> Column:
    """Struct x, y in the target system; no datum shift."""
    systems = systems or SYSTEMS
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    if systems[source] is None:
        return _forward(x, y, systems[target])
    back = _inverse(x, y, systems[source])
    return back if systems[target] is None else _forward(back["x"], back["y"], systems[target])

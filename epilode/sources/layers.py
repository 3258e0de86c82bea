"""Spatial layers as tables: attributes, `geom_wkb`, `srid`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilode.functions import geometry as G
from epilode.operators.spatial import reproject
from epilode.session import cut_lineage

HOME_SRID = 3435
#: Columns of a layer stored by region: the bounding box of each shape.
BOX = ["box_x1", "box_y1", "box_x2", "box_y2"]
_CURVE_BITS = 16


def layer_srid(layer: DataFrame, default: int = HOME_SRID) -> int:
    """The one reference system that a layer's `srid` column names.

    A layer without the column, or without rows, is in the default system; a layer that
    names several, or leaves some rows without one, is refused.
    """
    if "srid" not in layer.columns:
        return default
    found = [r["srid"] for r in layer.select("srid").distinct().limit(2).collect()]
    if len(found) > 1 or None in found:
        raise ValueError(f"the layer has no single reference system: {found}")
    return found[0] if found else default


def _decoded(stored: DataFrame, srid: int, source: int | None) -> DataFrame:
    source = layer_srid(stored) if source is None else source
    layer = stored.withColumn("geom", G.from_wkb(F.col("geom_wkb"))).drop("geom_wkb")
    return reproject(layer, source, srid)


def read_layer(spark: SparkSession, table: str, schema: str = "ref", srid: int = HOME_SRID) -> DataFrame:
    """Layer from a catalog table, in the wanted reference system.

    The table's `srid` column says which system it holds.
    """
    return _decoded(spark.read.table(f"{schema}.{table}" if schema else table), srid, None)


def read_layer_path(spark: SparkSession, path: str, srid: int = HOME_SRID, stored: int | None = None) -> DataFrame:
    """Layer from Parquet files, stored in the system that `stored` or their `srid` column names."""
    return _decoded(spark.read.parquet(path), srid, stored)


def read_layer_jdbc(spark: SparkSession, url: str, table: str, schema: str = "ref", srid: int = HOME_SRID,
                    columns: str = "*", bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Layer from a spatial database, its shape column sent as binary.

    `bounds` (numeric column, least value, greatest value, parts) reads the table in
    parts; without it one task reads everything.
    """
    rows = f"SELECT {columns}, geom.STAsBinary() AS geom_wkb, geom.STSrid AS srid FROM {schema}.{table}"
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({rows}) AS layer", **options)
    if bounds:
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        reader = reader.options(**{n: str(v) for n, v in zip(names, bounds)})
    return _decoded(reader.load().drop("geom"), srid, None)


def _encoded(layer: DataFrame, srid: int, source: int | None) -> DataFrame:
    moved = reproject(layer, layer_srid(layer) if source is None else source, srid)
    return moved.withColumn("geom_wkb", G.to_wkb(F.col("geom"))).drop("geom")


def write_layer(layer: DataFrame, table: str, schema: str = "ref", srid: int = HOME_SRID,
                source: int | None = None) -> DataFrame:
    """Overwrite a catalog table with the layer; returns its stored shapes.

    The layer is in the system that its `srid` column names, unless `source` does.
    """
    spark = layer.sparkSession
    name = f"{schema}.{table}" if schema else table
    if schema:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    _encoded(layer, srid, source).write.mode("overwrite").saveAsTable(name)
    return spark.read.table(name).select("geom_wkb", "srid")


def write_layer_path(layer: DataFrame, path: str, srid: int = HOME_SRID, source: int | None = None) -> str:
    """Write the layer as Parquet files."""
    _encoded(layer, srid, source).write.mode("overwrite").parquet(path)
    return path


def _along_curve(boxes: DataFrame) -> Column:
    """Place of a box's middle along a curve through the whole layer; -1 without a box."""
    c = F.col
    # One row: the extent of the layer.
    found = boxes.agg(*[F.min(b).alias(b) for b in BOX[:2]], *[F.max(b).alias(b) for b in BOX[2:]]).first()
    if found[BOX[0]] is None:
        return F.lit(-1).cast("bigint")
    cells = 1 << _CURVE_BITS

    def cell(low: str, high: str) -> Column:
        share = F.try_divide((c(low) + c(high)) / 2 - F.lit(found[low]), F.lit(found[high] - found[low]))
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells).cast("bigint"), F.lit(cells - 1).cast("bigint"))

    place = G.curve_place(cell("box_x1", "box_x2"), cell("box_y1", "box_y2"), _CURVE_BITS)
    return F.when(c("box_x1").isNull(), F.lit(-1).cast("bigint")).otherwise(place)


def write_layer_regions(layer: DataFrame, path: str, srid: int = HOME_SRID, source: int | None = None,
                        parts: int | None = None, rows_per_file: int = 1_000_000) -> str:
    """Write the layer as Parquet files that each hold neighbouring shapes, for `read_region`.

    Shapes are sorted along a space-filling curve through the middles of their boxes, which
    are stored as the columns `BOX` (columns of these names are replaced).  `parts` is the
    number of parts of the curve, by default the session's shuffle partitions; shapes at one
    place are dealt by a hash of their bytes, so a crowded place is no part of its own.
    Shapes that are null or have no points have no box and come first.
    """
    spark = layer.sparkSession
    moved = reproject(layer, layer_srid(layer) if source is None else source, srid)
    box = G.bounds(F.col("geom"))
    boxed = moved.withColumns({b: box[b.removeprefix("box_")] for b in BOX}).withColumn("geom_wkb", G.to_wkb(F.col("geom"))).drop("geom")
    # Written once and read three times: boxes alone for the extent, then a sample, then all for the shuffle.
    stored = cut_lineage(boxed, "layer")
    keys = [_along_curve(stored), F.xxhash64("geom_wkb")]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


def read_region(spark: SparkSession, path: str, region: tuple[float, float, float, float],
                srid: int = HOME_SRID, stored: int | None = None) -> DataFrame:
    """Shapes of a layer written by `write_layer_regions` whose boxes meet `region` (touching counts).

    `region` is (least x, least y, greatest x, greatest y) in the stored system.  The test is
    on stored columns, so Parquet's statistics leave out the files and row groups elsewhere.
    Shapes without a box lie in no region.
    """
    c = F.col
    x1, y1, x2, y2 = map(float, region)
    rows = spark.read.parquet(path).filter(
        (c("box_x1") <= x2) & (c("box_x2") >= x1) & (c("box_y1") <= y2) & (c("box_y2") >= y1)
    )
    return _decoded(rows.drop(*BOX), srid, stored)

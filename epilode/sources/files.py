"""Delimited files: gazetteers, reports, headerless lists, newest files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the reference lists.
CITIES = "city string, in_cook boolean"
CITY_ZIPS = "zip string, city string"
AREAS = "neighborhood string, community_area string"
STATE_ZIPS = "zip string, subcook boolean"


def _file_order():
    """Sortable place of a row: file, split of the file, row in the task.

    A split is read in order by one task, so the triple follows file order
    without sorting or passing the file through one task.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_gazetteer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and an explicit schema, plus `ordinal` (file order)."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(_file_order().alias("ordinal"), *[f"`{c}`" for c in df.columns])


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, area): neighbourhoods, then community areas, without lists."""
    raw = read_gazetteer(spark, path, AREAS)
    both = raw.select(
        F.posexplode(F.array("neighborhood", "community_area")).alias("part", "area"), "ordinal"
    ).filter("area is not null").filter(~F.col("area").contains(","))
    return both.groupBy("area").agg(F.min(F.struct("part", "ordinal")).alias("ordinal")).select("ordinal", "area")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and an explicit schema (names may hold blanks)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV without header; text columns with the given names."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", False).csv(path)


def read_report(spark: SparkSession, path: str, schema: str, skip: int = 3) -> DataFrame:
    """Report files with `skip` lines before the header, blank lines dropped.

    The lines of a file's first split reach one task in order, which passes over the
    leading ones: one scan, no join.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[str, int] = {}
        for batch in batches:
            files = batch.column(1).dictionary_encode()
            names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
            keep = np.ones(batch.num_rows, dtype=bool)
            head = batch.column(2).to_numpy() == 0
            for code, name in enumerate(names):
                left = skip + 1 - passed.get(name, 0)
                if left > 0:
                    mine = np.flatnonzero(head & (codes == code))
                    keep[mine[:left]] = False
                    passed[name] = passed.get(name, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["value"])

    rows = lines.mapInArrow(body, "value string").filter(F.length(F.btrim("value")) > 0)
    return rows.select(F.from_csv("value", schema).alias("r")).select("r.*")


def latest_files(spark: SparkSession, folder: str, pattern: str, extension: str = "xlsx", num: int = 1) -> DataFrame:
    """Newest `num` extracts in a folder whose name matches `pattern.*extension$`, oldest first.

    An extract is a file, or a folder of part files, which is as new as its newest part.
    Reads file metadata only; times are compared as times.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        "path", "modificationTime", "length"
    )
    # The part of the path that follows the folder's own name.
    below = F.substring_index("path", f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    named = files.withColumn("name", F.substring_index(below, "/", 1)).filter(F.col("name").rlike(f"{pattern}.*{extension}$"))
    whole = named.groupBy("name").agg(
        F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"),
    )
    newest = whole.orderBy(F.col("modificationTime").desc(), F.col("name").desc()).limit(num)
    path = F.concat(F.lit(f"{folder.rstrip('/')}/"), "name")
    return newest.orderBy("modificationTime", "name").select("name", path.alias("path"), "length", "modificationTime")


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    """Write as CSV and return the path."""
    df.write.mode("overwrite").option("header", header).csv(path)
    return path

"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


#: Bytes of an Arrow batch; texts may be long, and a worker holds a batch several times over.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """`mapInArrow` with batches of at most about `BATCH_BYTES`, from here on in the session."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, schema: pa.Schema, rows: Callable[[pa.RecordBatch], list[tuple] | pa.RecordBatch]) -> DataFrame:
    """A map with a function from a batch to row tuples (or a batch) of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield as_batch(rows(batch), schema)

    return map_batches(df, run, from_arrow_schema(schema))


def as_batch(rows: list[tuple] | pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Row tuples as a record batch of `schema`."""
    if isinstance(rows, pa.RecordBatch):
        return rows
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def add_column(
    df: DataFrame, names: list[str], into: str, kind: pa.DataType, inputs: list[Column], values: Callable[..., list]
) -> DataFrame:
    """The columns `names` of `df` and a new one, computed by task: no shuffle, no key.

    `values` gets a batch of each input as a list and returns the new column's values.
    Names may hold any character, so columns travel under numbers.
    """
    if into in names:
        raise ValueError(f"{into} is a column already")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    count, types = len(names), [df.schema[c].dataType for c in names]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*types, from_arrow_type(kind)])])
    numbered = [c.alias(f"c{i}") for i, c in enumerate(kept)] + [c.alias(f"x{i}") for i, c in enumerate(inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            new = pa.array(values(*(c.to_pylist() for c in columns[count:])), kind)
            yield pa.RecordBatch.from_arrays([*columns[:count], new], names=[f"c{i}" for i in range(count + 1)])

    return map_batches(df.select(*numbered), run, schema).toDF(*names, into)

"""Projections, headers, filters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters deleted from report headers.
HEADER_NOISE = r"[ /\-?:()']"
# Endings of the census estimate and margin columns.
ESTIMATE_SUFFIX = "(E|M)$"


def snake_name(name: str) -> str:
    """One header in snake case: `Zip Code` -> `zip_code`, `#` -> `number`."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9a-zA-Z]+", "_", text).strip("_").lower()
    if not text or text[0].isdigit():
        text = "x" + text
    return text


def clean_names(df: DataFrame) -> DataFrame:
    """All headers in snake case; repeats get `_2`, `_3`, ..."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        base = snake_name(column)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def strip_headers(df: DataFrame) -> DataFrame:
    """Delete blanks and punctuation from every header."""
    return df.toDF(*[re.sub(HEADER_NOISE, "", c) for c in df.columns])


def across_contains(df: DataFrame, part: str, fn: Callable[[Column], Column],
                    exact_tokens: bool = False) -> DataFrame:
    """Apply `fn` to every column whose name contains `part`, in any case.

    `Ethnicity` contains `city`, as in the behaviour modelled here; with
    `exact_tokens` a word of the header must equal `part`.
    """

    def wanted(name: str) -> bool:
        if not exact_tokens:
            return part.lower() in name.lower()
        return part.lower() in snake_name(name).split("_")

    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in df.columns if wanted(c)})


def select_range(df: DataFrame, first: str, last: str, keep: Iterable[str] = ()) -> DataFrame:
    """Columns from `first` to `last` by position, after those in `keep`."""
    i, j = df.columns.index(first), df.columns.index(last)
    step = 1 if j >= i else -1
    return df.select(*keep, *df.columns[i : j + step if j + step >= 0 else None : step])


def move_last(df: DataFrame, *names: str) -> DataFrame:
    """Move columns to the end."""
    return df.select(*[c for c in df.columns if c not in names], *names)


def drop_position(df: DataFrame, position: int = 2) -> DataFrame:
    """Drop the column at a 1-based position."""
    return df.drop(df.columns[position - 1])


def unnest(df: DataFrame, column: str) -> DataFrame:
    """Flatten a struct column, or an array of structs, into columns.

    A row without result keeps its place, with NULLs.
    """
    kind = df.schema[column].dataType.typeName()
    others = [c for c in df.columns if c != column]
    if kind == "array":
        df = df.select(*others, F.explode_outer(column).alias(column))
    return df.select(*others, f"{column}.*")


def drop_geometry(df: DataFrame, *columns: str) -> DataFrame:
    """Attributes of a layer without its shape."""
    return df.drop(*(columns or ("geom", "geom_wkb", "srid")))


def time_series(df: DataFrame, columns: Iterable[str] = ("date", "count"), name: str | None = None) -> DataFrame:
    """Selected columns of a feed table, date typed, tagged with the series name."""
    out = df.select(*columns)
    if "date" in out.columns:
        out = out.withColumn("date", F.to_date("date"))
    return out if name is None else out.withColumn("name", F.lit(name))


def keep_estimates(df: DataFrame, variable: str) -> DataFrame:
    """Rows whose variable ends in E or M (annotations end in EA, MA)."""
    return df.filter(F.col(variable).rlike(ESTIMATE_SUFFIX))


def discard_failed(results: DataFrame, status: str = "status", ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(successful rows, failed rows) of a per-key result table."""
    good = F.coalesce(F.col(status) == ok, F.lit(False))
    return results.filter(good), results.filter(~good)


def relabel(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """First pattern found in the text gives the label; NULL if none."""
    rules = list(rules)
    first = F.when(text.rlike(rules[0][0]), F.lit(rules[0][1]))
    return reduce(lambda c, r: c.when(text.rlike(r[0]), F.lit(r[1])), rules[1:], first)

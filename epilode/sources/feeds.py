"""Landed JSON and CSV payloads to rows.

Payloads arrive as a table with one payload per row; the calls themselves are
made elsewhere.

Arrays are exploded with the outer form and a test on the outcome: for the plain
form the optimizer tests the array beforehand, which parses every payload twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def details_rows(landed: DataFrame, payload: str, fields: str, keys: list[str], kind: str = "kind") -> DataFrame:
    """Rows of every landed feed payload.

    `kind` names the shape: `details` is an object with a `dataDetails` array,
    `csv` is text with a header line, `list` is an array of rows that may be
    wrapped in a list of one, or be the second item of a list of two.
    `fields` is the DDL of a row; a field missing from a payload is NULL.
    """
    row = f"struct<{_ddl(fields)}>"
    text = F.col(payload)
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    details = F.from_json(text, f"struct<dataDetails:array<{row}>>")["dataDetails"]

    # The header line decides which cell is which field.
    lines = F.filter(F.split(_guarded(text), r"\r?\n"), lambda x: F.length(x) > 0)
    head = _cells(F.element_at(lines, 1))

    table = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), _cells)

    def record(header: Column, cells: Column) -> Column:
        return F.struct(*[
            F.nullif(F.get(cells, (F.array_position(header, n) - 1).cast("int")), F.lit("")).try_cast(t).alias(n)
            for n, t in zip(names, _types(fields))
        ])

    # The outer step binds the header, so that it is split once per payload.
    csv = F.flatten(F.transform(F.array(head), lambda h: F.transform(table, lambda cells: record(h, cells))))

    # An array of rows, one wrapped in a list of one, or second in a list of two.
    plain = F.from_json(text, f"array<{row}>")
    single = F.from_json(text, f"array<array<{row}>>")
    second = F.from_json(F.get_json_object(text, "$[1]"), f"array<{row}>")
    size = F.json_array_length(text)
    nested = F.startswith(F.ltrim(F.get_json_object(text, "$[0]")), F.lit("["))
    pair = (size == 2) & F.startswith(F.ltrim(F.get_json_object(text, "$[1]")), F.lit("["))
    rows = (
        F.when(F.col(kind) == "details", details)
        .when(F.col(kind) == "csv", csv)
        .when((F.col(kind) == "list") & pair, second)
        .when((F.col(kind) == "list") & (size == 1) & nested, single[0])
        .when(F.col(kind) == "list", plain)
    )
    # One pass over the payloads, whatever their shape.
    return landed.select(*keys, F.explode_outer(rows).alias("r")).filter("r IS NOT NULL").select(*keys, "r.*")


# Stand for line ends inside quoted cells while lines are parted.
_INNER_ENDS = (("\n", "\u0001"), ("\r", "\u0002"))


def _guarded(text: Column) -> Column:
    """Text whose quoted line ends are replaced: they lie in every second part between quotes."""
    def guard(part: Column, i: Column) -> Column:
        inner = part
        for end, mark in _INNER_ENDS:
            inner = F.replace(inner, F.lit(end), F.lit(mark))
        return F.when(i % 2 == 1, inner).otherwise(part)

    return F.array_join(F.transform(F.split(text, '"', -1), guard), '"')


def _unguarded(cell: Column) -> Column:
    for end, mark in _INNER_ENDS:
        cell = F.replace(cell, F.lit(mark), F.lit(end))
    return cell


def _cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells may hold commas, line ends and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(
        raw,
        lambda x: F.when(
            F.startswith(x, F.lit('"')),
            _unguarded(F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))),
        ).otherwise(x),
    )


def _ddl(fields: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in fields.split(","))


def _types(fields: str) -> list[str]:
    return [f.strip().split(" ", 1)[1] for f in fields.split(",")]


def matrix_rows(landed: DataFrame, payload: str, keys: list[str], ids: list[str]) -> DataFrame:
    """Array-of-arrays responses, first row the header, to (keys, ids, variable, value).

    The header differs from response to response, so columns become rows.  A header name
    may repeat; a row that is shorter than the header has no value for the rest.  Payloads
    that can't be read give no rows here, but in `unreadable_payloads`.
    """
    parsed = landed.select(*keys, F.from_json(payload, "array<array<string>>").alias("m")).select(
        *keys, F.col("m")[0].alias("head"),
        F.posexplode_outer(F.slice("m", F.lit(2), F.size("m"))).alias("row_id", "row"),
    ).filter("row IS NOT NULL")

    def cell(name: str) -> Column:
        place = F.array_position("head", F.lit(name)).cast("int")
        return F.when(place > 0, F.get("row", place - 1)).alias(name)

    cells = F.filter(
        F.transform("head", lambda h, i: F.struct(h.alias("variable"), F.get("row", i).alias("value"))),
        lambda c: ~c["variable"].isin(ids),
    )
    rows = parsed.select(*keys, "row_id", *[cell(i) for i in ids], F.explode_outer(cells).alias("c"))
    return rows.filter("c.variable IS NOT NULL").select(*keys, "row_id", *ids, "c.variable", "c.value")


def _reason(text: Column, kind: str | None) -> Column:
    """Why a payload gives no or only some of its rows, NULL if it gives them all."""
    missing = F.when(text.isNull() | (F.btrim(text) == ""), F.lit("empty"))
    json = F.json_array_length(text)
    if kind is None:
        m = F.from_json(text, "array<array<string>>")
        short = F.exists(F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1))), lambda r: ~F.size(r).eqNullSafe(F.size(m[0])))
        return (
            missing.when(json.isNull() | m.isNull(), F.lit("not an array of rows"))
            .when(F.size(m) == 0, F.lit("no header"))
            .when(F.size(F.array_distinct(m[0])) < F.size(m[0]), F.lit("header names repeat"))
            .when(short, F.lit("rows of another length than the header"))
        )
    what = F.col(kind)
    return (
        missing.when(~F.coalesce(what.isin("details", "csv", "list"), F.lit(False)), F.lit("unknown kind"))
        .when((what == "details") & F.get_json_object(text, "$.dataDetails").isNull(), F.lit("no dataDetails array"))
        .when((what == "list") & json.isNull(), F.lit("not a list"))
    )


def unreadable_payloads(landed: DataFrame, payload: str, keys: list[str], kind: str | None = None) -> DataFrame:
    """(keys, reason) of the payloads that give no or only some of their rows.

    With `kind`, payloads are those of `details_rows`, else those of `matrix_rows`.
    """
    return landed.select(*keys, _reason(F.col(payload), kind).alias("reason")).filter("reason IS NOT NULL")


def keep_readable(landed: DataFrame, payload: str, kind: str | None = None) -> tuple[DataFrame, Observation]:
    """The payloads that can be read, and counts taken in the same pass.

    Once the returned rows have been used, `.get` of the observation holds `landed`, `kept`
    and `failed`.  What counts as failed is what `unreadable_payloads` lists.
    """
    counts, why = Observation(), "__why"
    marked = landed.withColumn(why, _reason(F.col(payload), kind))
    seen = marked.observe(
        counts, F.count(F.lit(1)).alias("landed"), F.count_if(F.col(why).isNull()).alias("kept"), F.count(why).alias("failed")
    )
    return seen.filter(F.col(why).isNull()).drop(why), counts


# ---- payloads whose fields are not declared ------------------------------------


def _variant_rows(payload: Column) -> Column:
    """The rows of a payload as an array of variants, whichever of the known shapes it has; NULL if none."""
    parsed = F.try_parse_json(payload)

    def rows(path: str) -> Column:
        return F.try_variant_get(parsed, path, "array<variant>")

    plain, size = rows("$"), F.size(rows("$"))
    # An object with its rows inside, rows second in a list of two, a list in a list, a list.
    return (
        F.when(rows("$.dataDetails").isNotNull(), rows("$.dataDetails"))
        .when((size == 2) & rows("$[1]").isNotNull(), rows("$[1]"))
        .when((size == 1) & rows("$[0]").isNotNull(), rows("$[0]"))
        .otherwise(plain)
    )


def _plain_type(found: str) -> str | None:
    """The column type for a field of a variant type; None for what has no single plain one."""
    return None if found.split("<")[0].split("(")[0] in ("VARIANT", "OBJECT", "ARRAY") else "string" if found == "VOID" else found


def undeclared_rows(landed: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Rows of landed JSON payloads whose fields nobody declared: the union of all fields, by name.

    A first pass gathers the fields and the type that holds all their values, one row per
    field name; a second reads them.  A field that a row lacks is NULL.  Numbers of several
    kinds get the wider type; fields that mix kinds, and nested ones, come as JSON text.
    Payloads and rows that are no JSON objects give no rows.
    """
    found = landed.select(*keys, F.explode_outer(_variant_rows(F.col(payload))).alias("r"))
    found = found.select(*keys, F.try_variant_get("r", "$", "map<string,variant>").alias("r")).filter("r IS NOT NULL")
    # One row per field name, however many payloads there are.
    fields = found.select(F.explode_outer("r").alias("name", "value")).filter("name IS NOT NULL").groupBy("name").agg(
        F.schema_of_variant_agg("value").alias("type")
    ).orderBy("name").collect()

    def column(name: str, kind: str) -> Column:
        value, plain = F.col("r")[F.lit(name)], _plain_type(kind)
        if plain:
            return F.try_variant_get(value, "$", plain).alias(name)
        text = F.schema_of_variant(value) == "STRING"
        return F.when(text, F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value)).alias(name)

    return found.select(*keys, *[column(f["name"], f["type"]) for f in fields])


_BATCH = (
    "struct<locations:array<struct<score:double,attributes:struct<"
    "ResultID:bigint,X:double,Y:double,Status:string,Match_addr:string,User_fld:string>>>>"
)
_SINGLE = (
    "struct<candidates:array<struct<score:double,location:struct<x:double,y:double>,"
    "attributes:struct<Match_addr:string,Addr_type:string,User_fld:string>>>>"
)


def geocode_batches(landed: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """One row per located address of each batch response."""
    hits = landed.select(*keys, F.explode_outer(F.from_json(payload, _BATCH)["locations"]).alias("l")).filter("l IS NOT NULL")
    a = "l.attributes."
    return hits.select(
        *keys, F.col(a + "ResultID").alias("OBJECTID"), F.col(a + "X").alias("X"), F.col(a + "Y").alias("Y"),
        F.col("l.score").alias("score"), F.col(a + "Status").alias("status"),
        F.col(a + "Match_addr").alias("address_match"), F.col(a + "User_fld").alias("residence_city"),
    )


def geocode_candidate(payload: Column) -> Column:
    """First candidate of a single-address response as a struct; NULL if there is none."""
    first = F.get(F.from_json(payload, _SINGLE)["candidates"], F.lit(0))
    return F.when(
        first.isNotNull(),
        F.struct(
            first["attributes"]["Match_addr"].alias("match_address"), first["score"].alias("score"),
            first["location"]["x"].alias("x"), first["location"]["y"].alias("y"),
            first["attributes"]["Addr_type"].alias("address_type"),
            first["attributes"]["User_fld"].alias("residence_city"),
        ),
    )

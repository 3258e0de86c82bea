"""Address batches out, geocoder answers back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V
from epilode.operators.joins import left_lookup
from epilode.operators.ordered import batch_id, number_rows
from epilode.sources.feeds import geocode_batches

_RESULT = ["X", "Y", "score", "status", "address_match", "residence_city"]


def add_batches(df: DataFrame, order: str, limit: int = V.BATCH_LIMIT) -> DataFrame:
    """Rows with `id_for_geocoding` (1, 2, ...) and their `batch`."""
    return number_rows(df, order, "id_for_geocoding").withColumn("batch", batch_id(F.col("id_for_geocoding"), limit))


def request_payloads(df: DataFrame, id_field: str, street: str, city: str, zip_code: str,
                     batch: str = "batch") -> DataFrame:
    """One JSON request body per batch; incomplete addresses are left out."""
    fields = F.struct(
        F.col(street).alias("ADDRESS"), F.col(city).alias("CITY"),
        F.col(zip_code).alias("POSTAL"), F.col(id_field).alias("OBJECTID"),
    )
    complete = df.dropna(subset=[street, city, zip_code, id_field])
    grouped = complete.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct(F.col(id_field).alias("o"), F.struct(fields.alias("attributes")).alias("r"))))
        .alias("a")
    )
    body = F.to_json(F.struct(F.transform("a", lambda x: x["r"]).alias("records")))
    return grouped.select(batch, body.alias("payload"))


def join_results(df: DataFrame, responses: DataFrame, payload: str, id_field: str, batch: str = "batch",
                 complete: list[str] | None = None, compatible: bool = True) -> DataFrame:
    """Input rows with the answers to their batches.

    responses(batch, payload, ok): a batch whose call failed has ok = FALSE and
    gives FAIL rows.  With `compatible=False`, rows that were never sent because
    one of `complete` is missing are SKIPPED instead of SUCCESS.
    """
    answers = geocode_batches(responses.filter("ok"), payload, [])
    failed = responses.filter(~F.col("ok")).select(F.col(batch).alias("__b")).distinct()
    rows = left_lookup(df, answers, {id_field: "OBJECTID"}).join(failed, F.col(batch) == F.col("__b"), "left")
    status = F.when(F.col("__b").isNotNull(), F.lit("FAIL"))
    if not compatible and complete:
        missing = F.greatest(*[F.col(c).isNull() for c in [*complete, complete[0]]])
        status = status.when(missing, F.lit("SKIPPED"))
    return rows.withColumn("geo_status", status.otherwise(F.lit("SUCCESS"))).drop("__b")

"""Sources and sinks.  Files and payloads are made from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import query
from epilode.operators.aggregates import collect_batches
from epilode.operators.columns import unnest
from epilode.plans.geocoding import join_results, request_payloads
from epilode.session import fresh_path
from epilode.sources import feeds, files


@query("src_gazetteer", "SELECT p_name AS city, p_size > 25 AS in_cook FROM part")
def _gazetteer(t):
    path = fresh_path(t.spark, "cities")
    files.write_csv(t.part.select(F.col("p_name").alias("city"), (F.col("p_size") > 25).alias("in_cook")), path)
    return files.read_gazetteer(t.spark, path, files.CITIES).drop("ordinal")


@query("src_report_csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _report(t):
    # One small report file per 500 parts, each with three lines before the header.
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"),
                       F.col("p_retailprice").cast("string"))
    bodies = (
        t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("file_no"))
        .agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
        .select("file_no", F.concat(F.lit("Patients, all\n\nrun 1\nKey,Name,Size,Price\n"), "body", F.lit("\n")).alias("value"))
    )
    path = fresh_path(t.spark, "reports")
    bodies.write.partitionBy("file_no").text(path)
    return files.read_report(t.spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query(
    "src_headerless",
    "SELECT CAST(c_custkey AS VARCHAR) AS zip, c_mktsegment AS city FROM customer",
)
def _headerless(t):
    path = fresh_path(t.spark, "headerless")
    files.write_csv(t.customer.select("c_custkey", "c_mktsegment"), path, header=False)
    return files.read_headerless(t.spark, path, ["zip", "city"])


@query("src_remote_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS zip, s_acctbal AS population FROM supplier")
def _remote(t):
    path = fresh_path(t.spark, "published")
    files.write_csv(t.supplier.select(F.col("s_suppkey").alias("Zip Code"), F.col("s_acctbal").alias("Population 2010")), path)
    rows = files.read_csv(t.spark, path, "`Zip Code` string, `Population 2010` double")
    return rows.select(F.col("`Zip Code`").alias("zip"), F.col("`Population 2010`").alias("population"))


@query(
    "src_latest_files",
    """
    SELECT 'cases_P.csv' AS extract, o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'
    """,
)
def _latest(t):
    # One extract per status, the last one written is the newest.
    folder, columns = fresh_path(t.spark, "extracts"), ["o_orderkey", "o_custkey", "o_totalprice"]
    for status in ("F", "O", "P"):
        files.write_csv(t.orders.filter(F.col("o_orderstatus") == status).select(*columns), f"{folder}/cases_{status}.csv")
    newest = files.latest_files(t.spark, folder, "cases", "csv").first()
    rows = files.read_csv(t.spark, newest["path"], "o_orderkey bigint, o_custkey bigint, o_totalprice double")
    return rows.select(F.lit(newest["name"]).alias("extract"), *columns)


@query("sink_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _sink(t):
    path = fresh_path(t.spark, "orders_csv")
    files.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return files.read_csv(
        t.spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    )


@query(
    "src_details_json",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, event_type AS condition,
           CASE WHEN event_id // 250 % 5 = 0 AND value < 10 THEN NULL ELSE value END AS value FROM events
    """,
)
def _details(t):
    rows = t.events.select(
        F.floor(F.col("event_id") / 250).alias("batch"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("event_type").alias("condition"), "value",
    )
    shape = F.col("batch") % 5
    # A value below 10 is left out of the records of the first shape.
    rows = rows.withColumn("value", F.when((shape != 0) | (F.col("value") >= 10), F.col("value")))
    arrays = collect_batches(rows, "batch", "event_id", {c: c for c in ("event_id", "date", "condition", "value")}, "r")
    lines = F.transform("r", lambda x: F.concat_ws(",", x["value"].cast("string"), x["date"], x["event_id"].cast("string"),
                                                    F.concat(F.lit('"'), x["condition"], F.lit('"'))))
    # CSV columns in another order than the declared one.
    csv = F.concat(F.lit("value,date,event_id,condition\n"), F.array_join(lines, "\n"))
    json = F.to_json("r")
    payload = (
        F.when(shape == 0, F.to_json(F.struct(F.col("r").alias("dataDetails"))))
        .when(shape == 1, csv)
        .when(shape == 2, json)
        .when(shape == 3, F.concat(F.lit("["), json, F.lit("]")))
        .otherwise(F.concat(F.lit('["series",'), json, F.lit("]")))
    )
    kind = F.when(shape == 0, F.lit("details")).when(shape == 1, F.lit("csv")).otherwise(F.lit("list"))
    landed = arrays.select("batch", payload.alias("payload"), kind.alias("kind"))
    fields = "event_id bigint, date string, condition string, value double"
    return feeds.details_rows(landed, "payload", fields, ["batch"]).drop("batch")


@query(
    "src_undeclared_json",
    """
    SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS condition, CASE WHEN value >= 10 THEN value END AS value,
           CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id FROM events
    """,
)
def _undeclared(t):
    # Ragged rows in four shapes; neither fields nor shape are told to the reader.
    rows = t.events.select(
        F.floor(F.col("event_id") / 250).alias("batch"), "event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("condition"),
        F.when(F.col("value") >= 10, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"),
    )
    arrays = collect_batches(rows, "batch", "event_id", {c: c for c in ("event_id", "condition", "value", "user_id")}, "r")
    json, shape = F.to_json("r"), F.col("batch") % 4
    payload = (
        F.when(shape == 0, F.to_json(F.struct(F.col("r").alias("dataDetails"))))
        .when(shape == 1, json)
        .when(shape == 2, F.concat(F.lit("["), json, F.lit("]")))
        .otherwise(F.concat(F.lit('["series",'), json, F.lit("]")))
    )
    found = feeds.undeclared_rows(arrays.select("batch", payload.alias("payload")), "payload", ["batch"])
    return found.select("event_id", "condition", F.col("value").cast("double").alias("value"), "user_id")


@query(
    "src_matrix_json",
    """
    SELECT c_custkey // 500 AS batch, c_name AS "NAME", CAST(c_custkey AS VARCHAR) AS "GEO_ID", variable, value FROM (
      SELECT c_custkey, c_name, 'B01E' AS variable, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS value FROM customer
      UNION ALL SELECT c_custkey, c_name, 'B01M', CAST(c_nationkey AS VARCHAR) FROM customer
      UNION ALL SELECT c_custkey, c_name, 'state', '17' FROM customer)
    """,
)
def _matrix(t):
    row = F.array("c_name", F.col("c_custkey").cast("string"), F.floor("c_acctbal").cast("string"),
                  F.col("c_nationkey").cast("string"), F.lit("17"))
    bodies = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("batch")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = F.array(F.array(*[F.lit(x) for x in ("NAME", "GEO_ID", "B01E", "B01M", "state")]))
    landed = bodies.select("batch", F.to_json(F.concat(head, "rows")).alias("payload"))
    return feeds.matrix_rows(landed, "payload", ["batch"], ["NAME", "GEO_ID"]).drop("row_id")


@query(
    "src_geocode_batch",
    """
    SELECT c_custkey AS "OBJECTID", c_acctbal AS "X", c_nationkey * 1.5 AS "Y", 100.0 - c_nationkey AS score, 'M' AS status,
           c_name AS address_match, c_mktsegment AS residence_city FROM customer
    """,
)
def _geocode_batch(t):
    location = F.struct(
        (F.lit(100.0) - F.col("c_nationkey")).alias("score"),
        F.struct(
            F.col("c_custkey").alias("ResultID"), F.col("c_acctbal").alias("X"), (F.col("c_nationkey") * 1.5).alias("Y"),
            F.lit("M").alias("Status"), F.col("c_name").alias("Match_addr"), F.col("c_mktsegment").alias("User_fld"),
        ).alias("attributes"),
    )
    landed = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("batch")).agg(
        F.to_json(F.struct(F.collect_list(location).alias("locations"))).alias("payload")
    )
    return feeds.geocode_batches(landed, "payload", [])


@query(
    "src_geocode_single",
    """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS match_address, CASE WHEN c_acctbal >= 0 THEN 99.5 END AS score,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x, CASE WHEN c_acctbal >= 0 THEN c_nationkey * 1.0 END AS y,
           CASE WHEN c_acctbal >= 0 THEN 'PointAddress' END AS address_type, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS residence_city
    FROM customer
    """,
)
def _geocode_single(t):
    def candidate(score: float, kind: str):
        return F.struct(
            F.lit(score).alias("score"),
            F.struct(F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y")).alias("location"),
            F.struct(F.col("c_name").alias("Match_addr"), F.lit(kind).alias("Addr_type"), F.col("c_mktsegment").alias("User_fld"))
            .alias("attributes"),
        )

    found = F.to_json(F.struct(F.array(candidate(99.5, "PointAddress"), candidate(50.0, "StreetName")).alias("candidates")))
    payload = F.when(F.col("c_acctbal") >= 0, found).otherwise(F.lit('{"candidates":[]}'))
    rows = t.customer.select("c_custkey", payload.alias("payload"))
    return unnest(rows.select("c_custkey", feeds.geocode_candidate(F.col("payload")).alias("result")), "result")


@query(
    "sink_geocode_payload",
    """
    SELECT (c_custkey + 1) // 2000 AS batch,
           to_json({'records': list({'attributes': {'ADDRESS': c_name, 'CITY': c_mktsegment, 'POSTAL': CAST(c_nationkey AS VARCHAR),
                                                    'OBJECTID': c_custkey}} ORDER BY c_custkey)}) AS payload
    FROM customer WHERE c_nationkey <> 7 GROUP BY (c_custkey + 1) // 2000
    """,
)
def _payload(t):
    # One nation's customers lack a zip and are left out of the request.
    rows = t.customer.withColumn("batch", F.floor((F.col("c_custkey") + 1) / 2000)).withColumn(
        "postal", F.when(F.col("c_nationkey") != 7, F.col("c_nationkey").cast("string"))
    )
    return request_payloads(rows, "c_custkey", "c_name", "c_mktsegment", "postal")


@query(
    "geo_join_results",
    """
    WITH c AS (SELECT *, c_custkey // 500 % 3 = 1 AS failed, c_nationkey <> 7 AS whole FROM customer)
    SELECT c_custkey, c_custkey // 500 AS batch, CASE WHEN whole AND NOT failed THEN c_acctbal END AS "X",
           CASE WHEN whole AND NOT failed THEN 90.0 END AS score, CASE WHEN whole AND NOT failed THEN c_name END AS address_match,
           CASE WHEN failed THEN 'FAIL' WHEN NOT whole THEN 'SKIPPED' ELSE 'SUCCESS' END AS geo_status FROM c
    """,
)
def _join_results(t):
    # Every third batch fails; one nation's addresses lack a zip and are not sent.
    batch = F.floor(F.col("c_custkey") / 500)
    rows = t.customer.select(
        "c_custkey", batch.alias("batch"), "c_name", "c_acctbal", F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")).alias("postal")
    )
    location = F.struct(
        F.lit(90.0).alias("score"),
        F.struct(F.col("c_custkey").alias("ResultID"), F.col("c_acctbal").alias("X"), F.lit(1.0).alias("Y"), F.lit("M").alias("Status"),
                 F.col("c_name").alias("Match_addr"), F.lit("x").alias("User_fld")).alias("attributes"),
    )
    bodies = rows.groupBy("batch").agg(F.collect_list(F.when(F.col("postal").isNotNull(), location)).alias("locations"))
    ok = F.col("batch") % 3 != 1
    responses = bodies.select("batch", F.when(ok, F.to_json(F.struct("locations"))).alias("payload"), ok.alias("ok"))
    out = join_results(rows, responses, "payload", "c_custkey", "batch", ["postal"], compatible=False)
    return out.select("c_custkey", "batch", "X", "score", "address_match", "geo_status")


@query(
    "src_unreadable",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'not an array of rows' WHEN '2-HIGH' THEN 'empty'
           WHEN '3-MEDIUM' THEN 'rows of another length than the header' ELSE 'header names repeat' END AS reason
    FROM orders WHERE o_orderpriority <> '5-LOW'
    """,
)
def _unreadable(t):
    kind = F.col("o_orderpriority")
    payload = (
        F.when(kind == "1-URGENT", F.lit("{oops"))
        .when(kind == "2-HIGH", F.lit(" "))
        .when(kind == "3-MEDIUM", F.concat(F.lit('[["a","b"],["1"]'), F.lit("]")))
        .when(kind == "5-LOW", F.lit('[["a","b"],["1","2"]]'))
        .otherwise(F.lit('[["a","a"],["1","2"]]'))
    )
    landed = t.orders.select("o_orderkey", payload.alias("payload"))
    return feeds.unreadable_payloads(landed, "payload", ["o_orderkey"])

"""Aggregates, shares and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import query
from epilode.operators import aggregates as A
from epilode.operators import ordered as O
from epilode.plans.geocoding import add_batches
from epilode.plans.reports import weekly_report
from epilode.session import cut_lineage

# Events and orders as samples: type or priority = site, day = sample date.


@query("agg_count", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def _count(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_freq_pct",
    """
    WITH r AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority || o_orderstatus END AS result FROM orders)
    SELECT result, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM r) * 100, 1) AS pct
    FROM r WHERE result IS NOT NULL GROUP BY result ORDER BY n DESC
    """,
)
def _freq(t):
    result = F.when(F.col("o_orderpriority") != "5-LOW", F.concat("o_orderpriority", "o_orderstatus"))
    return A.frequency(t.orders.select(result.alias("result")), "result").orderBy(F.desc("n"))


@query(
    "agg_cond_count",
    """
    WITH e AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN value < 0.1 THEN NULL ELSE event_type END AS site FROM events)
    SELECT day, CASE WHEN count(site) = count(*) THEN count(*) FILTER (site <> 'signup') END AS n FROM e GROUP BY day
    """,
)
def _cond(t):
    site = F.when(F.col("value") >= 0.1, F.col("event_type"))
    rows = t.events.select(F.to_date("ts").alias("day"), site.alias("site"))
    return A.count_if(rows, ["day"], F.col("site") != "signup")


@query(
    "agg_first_per_group",
    """
    SELECT user_id, event_type, arg_min(value, ROW(ts, event_id)) AS value, arg_min(event_id, ROW(ts, event_id)) AS event_id
    FROM events GROUP BY user_id, event_type
    """,
)
def _first(t):
    return A.first_per_group(t.events, ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query(
    "agg_site_reference",
    """
    WITH e AS (SELECT user_id, CASE WHEN value < 0.1 THEN NULL ELSE value END AS marker, value AS flow FROM events)
    SELECT user_id, round(CASE WHEN count(marker) = count(*) THEN avg(marker) END, 6) AS marker_mean, round(avg(flow), 6) AS flow_mean
    FROM e GROUP BY user_id
    """,
)
def _reference(t):
    rows = t.events.select("user_id", F.when(F.col("value") >= 0.1, F.col("value")).alias("marker"), F.col("value").alias("flow"))
    return A.site_means(rows, "user_id", {"marker": "marker_mean", "flow": "flow_mean"}).select(
        "user_id", F.round("marker_mean", 6).alias("marker_mean"), F.round("flow_mean", 6).alias("flow_mean")
    )


@query(
    "agg_median_sd",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 6) AS median, round(stddev_samp(l_extendedprice), 6) AS sd
    FROM lineitem GROUP BY ALL
    """,
)
def _median(t):
    return A.median_sd(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice").select(
        "l_returnflag", "l_linestatus", "n", F.round("median", 6).alias("median"), F.round("sd", 6).alias("sd")
    )


@query(
    "agg_min_max_date",
    "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY o_custkey",
)
def _min_max(t):
    day = F.to_date("o_orderdate")
    return t.orders.groupBy("o_custkey").agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query(
    "agg_distinct_count",
    """
    WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN value >= 0.5 THEN value END AS v FROM events),
         s AS (SELECT event_type, count(DISTINCT day) AS n_dates, count(*) FILTER (v IS NULL) AS n_missing FROM e GROUP BY event_type)
    SELECT event_type, n_dates, n_missing, n_dates - n_missing AS n_samples, CAST(floor((n_dates - n_missing) / 5) AS INTEGER) AS k_max FROM s
    """,
)
def _support(t):
    rows = t.events.select("event_type", F.to_date("ts").alias("day"), F.when(F.col("value") >= 0.5, F.col("value")).alias("v"))
    return A.sample_support(rows, ["event_type"], "day", "v")


@query(
    "agg_sum_filtered",
    """
    SELECT n_regionkey, sum(CASE WHEN n_name IN ('NATION_1', 'NATION_7', 'NATION_13', 'NATION_24') THEN round(s_acctbal * 100)::BIGINT END)::BIGINT AS cents
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey
    """,
)
def _sum_filtered(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    listed = F.col("n_name").isin("NATION_1", "NATION_7", "NATION_13", "NATION_24")
    return rows.groupBy("n_regionkey").agg(
        F.sum(F.when(listed, F.round(F.col("s_acctbal") * 100).cast("bigint"))).alias("cents")
    )


@query(
    "agg_pivot_long",
    """
    UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem)
    ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value
    """,
)
def _long(t):
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    return A.to_long(t.lineitem, ids, ["l_quantity", "l_discount", "l_tax"])


@query(
    "agg_pivot_wide",
    """
    SELECT user_id, event_type AS variable, max(value) FILTER (kind = 'E') AS estimate, max(value) FILTER (kind = 'M') AS moe
    FROM (SELECT *, CASE WHEN value < 20 THEN 'M' ELSE 'E' END AS kind FROM events) GROUP BY user_id, event_type
    """,
)
def _wide(t):
    rows = t.events.select("user_id", F.col("event_type").alias("variable"), "value",
                           F.when(F.col("value") < 20, F.lit("M")).otherwise(F.lit("E")).alias("kind"))
    return A.to_wide(rows, ["user_id", "variable"], "kind", "value", {"E": "estimate", "M": "moe"})


@query(
    "agg_collect_batch",
    """
    SELECT o_orderkey // 500 AS batch, to_json(list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)) AS records
    FROM orders GROUP BY o_orderkey // 500
    """,
)
def _batch(t):
    rows = t.orders.withColumn("batch", F.floor(F.col("o_orderkey") / 500))
    out = A.collect_batches(rows, "batch", "o_orderkey", {"o_orderkey": "id", "o_orderstatus": "status"})
    return out.withColumn("records", F.to_json("records"))


# ---- windows -----------------------------------------------------------------


@query(
    "win_first_row",
    """
    SELECT event_id, event_type, CAST(ts AS DATE) AS day, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY CASE WHEN value < 5 THEN NULL ELSE ts END ASC NULLS LAST, event_id) = 1
    """,
)
def _first_row(t):
    rows = t.events.select("event_id", "event_type", F.to_date("ts").alias("day"), "value", "ts")
    time = F.when(F.col("value") >= 5, F.col("ts"))
    return O.first_row(rows, ["event_type", "day"], [time.asc_nulls_last(), F.col("event_id").asc()]).drop("ts")


@query(
    "win_group_size",
    "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS num_sites FROM orders QUALIFY num_sites = 8",
)
def _size(t):
    return O.with_group_size(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").filter("num_sites = 8")


@query(
    "win_group_mean",
    "SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type), 6) AS site_mean FROM events",
)
def _mean(t):
    rows = A.attach(t.events.select("event_id", "event_type", "value"), ["event_type"], site_mean=F.avg("value"))
    return rows.select("event_id", "event_type", F.round("site_mean", 6).alias("site_mean"))


@query(
    "win_share",
    """
    WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT day, event_type, n, round_even(n / sum(n) OVER (PARTITION BY day) * 100, 1) AS proportion,
           round_even(n / sum(n) OVER () * 100, 1) AS of_all FROM c
    """,
)
def _share(t):
    counts = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts, "counts")
    return A.add_share(A.add_share(counts, "n", ["day"]), "n", out="of_all")


@query(
    "win_batch_id",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id_for_geocoding,
           row_number() OVER (ORDER BY o_orderkey) // 2000 AS batch FROM orders
    """,
)
def _batch_id(t):
    return add_batches(t.orders.select("o_orderkey"), "o_orderkey")


@query(
    "win_next_level",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_size // 10 = 2 THEN 1 ELSE p_size // 10 END AS code FROM part),
         s AS (SELECT code, lead(code) OVER (ORDER BY code) AS following FROM (SELECT DISTINCT code FROM p))
    SELECT p_partkey, CASE WHEN following IS NOT NULL THEN (code * 10) || ' - ' || (following * 10 - 1) || '.9'
                           ELSE 'More than ' || (code * 10) END AS size_band
    FROM p JOIN s USING (code)
    """,
)
def _next_level(t):
    # Two bands made one: the codes have a gap.
    code = F.floor(F.col("p_size") / 10).cast("int")
    code = F.when(code == 2, 1).otherwise(code)
    cut = F.concat(F.lit("["), (code * 10).cast("string"), F.lit(","), (code * 10 + 10).cast("string"), F.lit(")"))
    rows = t.part.select("p_partkey", code.alias("code"), cut.alias("interval"))
    labels = O.label_levels(rows.select("code", "interval").distinct()).select(F.col("code").alias("c"), "pretty")
    return rows.join(labels, F.col("code") == F.col("c")).select("p_partkey", F.col("pretty").alias("size_band"))


@query(
    "win_next_day_delta",
    """
    WITH d AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
    SELECT a.event_type, a.user_id, a.day, a.n, b.n - a.n AS delta
    FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND a.user_id = b.user_id AND b.day = a.day + 1
    """,
)
def _delta(t):
    daily = t.events.groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return O.next_day_delta(daily, ["event_type", "user_id"], "day", "n")


@query(
    "win_date_align",
    """
    WITH e AS (SELECT o_orderkey, o_orderpriority AS site, CAST(o_orderdate AS DATE) AS day FROM orders),
         late AS (SELECT day + 1 AS d FROM e GROUP BY day HAVING count(*) FILTER (site <> '5-LOW') = 4)
    SELECT o_orderkey, site, CASE WHEN site = '5-LOW' AND day IN (SELECT d FROM late) THEN day - 1 ELSE day END AS day FROM e
    """,
)
def _align(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("day"))
    late = O.late_dates(rows, "site", "day", "5-LOW", 4)
    return O.align_late_site(rows, late, "site", "day", "5-LOW")


# ---- order -------------------------------------------------------------------


@query("sort_asc", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal ASC NULLS LAST, s_suppkey")
def _sort(t):
    return t.supplier.select("s_suppkey", "s_name", "s_acctbal").orderBy(F.col("s_acctbal").asc_nulls_last(), "s_suppkey")


@query("sort_freq_desc", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name")
def _sort_freq(t):
    return t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_name")


@query("topk_latest", "SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 5")
def _latest(t):
    return O.latest(t.events.select("event_id", "ts"), "ts", 5)


@query(
    "topk_argmin",
    """
    SELECT l_suppkey, arg_min(l_orderkey, ROW(l_extendedprice, l_orderkey, l_linenumber, l_partkey)) AS l_orderkey,
           min(l_extendedprice) AS l_extendedprice
    FROM lineitem GROUP BY l_suppkey
    """,
)
def _argmin(t):
    rows = t.lineitem.withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return O.argmin(rows, ["l_suppkey"], "l_extendedprice", "tie", ["l_orderkey", "l_extendedprice"])


@query("sample_n", "SELECT * FROM orders ORDER BY md5('1:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000")
def _sample(t):
    return O.sample_n(t.orders, "o_orderkey", 1000)


# ---- flagship ----------------------------------------------------------------


@query(
    "weekly_report",
    """
    WITH e AS (SELECT event_type, CAST(ts AS DATE) - CAST(dayofweek(CAST(ts AS DATE)) AS INTEGER) AS ws FROM events),
         c AS (SELECT ws, event_type, count(*) AS n FROM e GROUP BY ALL)
    SELECT ws AS week_start, ws + 6 AS week_end, CAST(year(ws + 3) AS INTEGER) AS week_year,
           CAST((dayofyear(ws + 3) - 1) // 7 + 1 AS INTEGER) AS week, event_type, n,
           round_even(n / sum(n) OVER (PARTITION BY ws) * 100, 1) AS proportion,
           CASE WHEN n > 0 AND n < 5 THEN NULL ELSE n END AS n_shown FROM c
    """,
)
def _weekly(t):
    return weekly_report(t.events, "ts", "event_type")

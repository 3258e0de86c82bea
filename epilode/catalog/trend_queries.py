"""Wastewater preparation and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import query
from epilode.operators import trend as T
from epilode.plans.wastewater import normalise_sites
from epilode.session import cut_lineage

_SAMPLES_SQL = """
    raw AS (SELECT o_orderkey, o_orderpriority AS site, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v,
                   o_custkey + 1.0 AS marker, o_totalprice / 1000 AS flow,
                   CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS tm FROM orders)
"""


@query(
    "ww_prepare",
    f"""
    WITH {_SAMPLES_SQL},
      late AS (SELECT day + 1 AS d FROM raw GROUP BY day HAVING count(*) FILTER (site <> '5-LOW') = 4),
      one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY site, day ORDER BY tm ASC NULLS LAST, o_orderkey) = 1),
      al AS (SELECT * EXCLUDE (day), day AS own, CASE WHEN site = '5-LOW' AND day IN (SELECT d FROM late) THEN day - 1 ELSE day END AS day FROM one),
      full_days AS (SELECT * FROM al QUALIFY count(*) OVER (PARTITION BY day) = 5),
      means AS (SELECT site, avg(marker) AS mm, avg(flow) AS fm FROM full_days GROUP BY site),
      firsts AS (SELECT site, day, arg_min(v, own) AS v, arg_min(marker, own) AS marker FROM full_days GROUP BY site, day)
    SELECT f.site, f.day, f.v AS value, round(f.v * fm * (mm / f.marker), 1) AS norm
    FROM firsts f JOIN means m ON f.site = m.site
    """,
)
def _prepare(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("value"), (F.col("o_custkey") + 1.0).alias("marker"),
        (F.col("o_totalprice") / 1000).alias("flow"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("time"),
    )
    out = normalise_sites(raw, {"t": "value"}, site="site", date="day", time="time", marker="marker", flow="flow",
                          late_site="5-LOW", sites=5)
    return out.select("site", "day", "value", F.round("t_flow_pmmov_norm_site", 1).alias("norm"))


def _series(t):
    """Mean value per event type and day; a low mean counts as missing."""
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return daily.withColumn("value", F.when(F.col("value") < 45, F.lit(None)).otherwise(F.col("value")))


@query(
    "trend_outlier_filter",
    """
    WITH m AS (SELECT event_type, median(value) + 5 * stddev_samp(value) AS lim FROM events GROUP BY event_type)
    SELECT event_id, e.event_type, value FROM events e JOIN m ON e.event_type = m.event_type WHERE value < lim
    """,
)
def _outliers(t):
    return T.drop_outliers(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")


@query(
    "trend_min_samples",
    """
    WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN value > 2 THEN value END AS v FROM events),
         s AS (SELECT user_id, event_type, count(DISTINCT day) AS n_dates, count(*) - count(v) AS n_missing FROM e GROUP BY ALL)
    SELECT *, n_dates - n_missing AS n_samples, CAST(floor((n_dates - n_missing) / 5) AS INTEGER) AS k_max,
           CASE WHEN floor((n_dates - n_missing) / 5) < 4 THEN 'insufficient' ELSE 'ok' END AS status FROM s
    """,
)
def _support(t):
    rows = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"),
                           F.when(F.col("value") > 2, F.col("value")).alias("v"))
    return T.trend_support(rows, ["user_id", "event_type"], "day", "v")


_GROWTH_SQL = """
    n AS (SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS d0 FROM events GROUP BY event_type),
    g AS (SELECT DISTINCT e.event_type, CAST(ts AS DATE) AS day, n, CAST(ts AS DATE) - d0 AS i FROM events e JOIN n USING (event_type))
"""


def _growth(t):
    """Each type's event count, growing by a tenth (in logs) per five days from its first day."""
    day = F.to_date("ts")
    per_day = cut_lineage(t.events.groupBy("event_type", day.alias("day")).agg(F.count(F.lit(1)).alias("c")), "per_day")
    per_type = per_day.groupBy("event_type").agg(F.sum("c").alias("n"), F.min("day").alias("d0"))
    rows = per_day.join(per_type, "event_type")
    return rows.withColumn("value", F.col("n") * F.exp(0.02 * F.datediff("day", "d0")))


@query(
    "trend_fit",
    """
    WITH m AS (SELECT event_type, median(value) + 5 * stddev_samp(value) AS lim FROM events GROUP BY event_type),
         e AS (SELECT e.event_type, value FROM events e JOIN m ON e.event_type = m.event_type WHERE value < lim)
    SELECT event_type, 'ok' AS status, count(*) AS n, round(avg(value), 4) AS fitted_mean FROM e GROUP BY event_type
    """,
)
def _fit(t):
    # The intercept is not penalised, so fitted and observed values have the same sum.
    rows = cut_lineage(t.events.select("event_type", F.to_date("ts").alias("day"), "value"), "event_values")
    curves = T.trend_curve(rows, ["event_type"], "day", "value")
    used = T.drop_outliers(rows, ["event_type"], "value").groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    fitted = curves.join(used, ["event_type", "day"])
    mean = F.sum(F.col("pred") * F.col("n")) / F.sum("n")
    return fitted.groupBy("event_type", "status").agg(F.sum("n").alias("n"), F.round(mean, 4).alias("fitted_mean"))


@query(
    "agg_model_select",
    """
    WITH c AS (SELECT event_type, CAST(4 + user_id % 9 AS INTEGER) AS k, round(stddev_samp(value), 12) AS resid_sd
               FROM events GROUP BY ALL)
    SELECT event_type, arg_min(k, ROW(resid_sd, k)) AS k FROM c GROUP BY event_type
    """,
)
def _select(t):
    candidates = t.events.groupBy("event_type", (4 + F.col("user_id") % 9).cast("int").alias("k")).agg(
        F.stddev_samp("value").alias("resid_sd")
    )
    return T.choose_model(candidates, ["event_type"])


@query(
    "trend_derivative_ci",
    f"""
    WITH {_GROWTH_SQL} SELECT event_type, day, 0.02::DOUBLE AS fst_deriv, round(exp(0.02 * i), 4) AS pred_per_start,
      TRUE AS interval_holds FROM g
    """,
)
def _derivative(t):
    series = _growth(t)
    curves = T.trend_curve(series, ["event_type"], "day", "value")
    start = series.select("event_type", "n").distinct()
    holds = (F.col("fst_deriv_ll") <= F.col("fst_deriv")) & (F.col("fst_deriv") <= F.col("fst_deriv_ul"))
    return curves.join(start, "event_type").select(
        "event_type", "day", F.round("fst_deriv", 4).alias("fst_deriv"),
        F.round(F.col("pred") / F.col("n"), 4).alias("pred_per_start"), holds.alias("interval_holds"),
    )


@query(
    "trend_interval",
    """
    WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL),
         g AS (SELECT event_type, count(*) FILTER (value >= 45) AS samples FROM s GROUP BY event_type),
         few AS (SELECT DISTINCT 'first days' AS event_type FROM events)
    SELECT s.event_type, day, 'ok' AS status, TRUE AS symmetric, 2.905847::DOUBLE AS widths
    FROM s JOIN g ON s.event_type = g.event_type WHERE samples >= 20
    UNION ALL SELECT event_type, NULL, 'insufficient', NULL, NULL FROM g WHERE samples < 20
    UNION ALL SELECT event_type, NULL, 'insufficient', NULL, NULL FROM few
    """,
)
def _interval(t):
    """Bounds lie evenly around the slope, and their widths follow the confidence level."""
    series = _series(t)
    first = series.groupBy("event_type").agg(F.min("day").alias("d0")).withColumnRenamed("event_type", "e")
    # A group of too few days: it comes back as a row that says so.
    few = series.join(first, F.col("event_type") == F.col("e")).filter("day < date_add(d0, 2)").select(
        F.lit("first days").alias("event_type"), "day", "value"
    )
    rows = cut_lineage(series.unionByName(few), "interval_series")
    models = cut_lineage(T.fit_trends(rows, ["event_type"], "day", "value"), "interval_models")
    wide = T.trend_curve(rows, ["event_type"], "day", "value", 0.95, models)
    half = T.trend_curve(rows, ["event_type"], "day", "value", 0.5, models).select(
        F.col("event_type").alias("e"), F.col("day").alias("d"), (F.col("fst_deriv_ul") - F.col("fst_deriv_ll")).alias("half")
    )
    width = F.col("fst_deriv_ul") - F.col("fst_deriv_ll")
    middle = (F.col("fst_deriv_ul") + F.col("fst_deriv_ll")) / 2
    both = wide.join(half, F.col("event_type").eqNullSafe(F.col("e")) & F.col("day").eqNullSafe(F.col("d")))
    return both.select(
        "event_type", "day", "status", (F.abs(middle - F.col("fst_deriv")) < 1e-9).alias("symmetric"),
        F.round(width / F.col("half"), 6).alias("widths"),
    )


@query(
    "trend_names",
    """
    WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'r' END AS target, CAST(ts AS DATE) AS day FROM events),
         n AS (SELECT target, count(*)::DOUBLE AS n FROM e GROUP BY target),
         d AS (SELECT DISTINCT target, day FROM e)
    SELECT day, max(n) FILTER (target = 'a') AS inf_a_start, max(n) FILTER (target = 'r') AS rsv_start,
           max(0.02::DOUBLE) FILTER (target = 'a') AS inf_a_fst_deriv, max(0.02::DOUBLE) FILTER (target = 'r') AS rsv_fst_deriv,
           'day,inf_a_copies_pred,inf_a_fst_deriv,inf_a_fst_deriv_ll,inf_a_fst_deriv_ul,rsv_copies_pred,rsv_fst_deriv,rsv_fst_deriv_ll,rsv_fst_deriv_ul' AS names
    FROM d JOIN n USING (target) GROUP BY day
    """,
)
def _names(t):
    target = F.when(F.col("user_id") % 2 == 0, F.lit("inf_a_copies")).otherwise(F.lit("rsv_copies"))
    per_day = cut_lineage(t.events.groupBy(target.alias("target"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c")), "per_day")
    per_target = per_day.groupBy("target").agg(F.sum("c").alias("n"), F.min("day").alias("d0"))
    rows = per_day.join(per_target, "target").withColumn("value", F.col("n") * F.exp(0.02 * F.datediff("day", "d0")))
    curves = T.trend_curve(rows, ["target"], "day", "value")
    # The growth taken out again, what is left is the start.
    first = rows.agg(F.min("d0")).scalar()
    wide = T.wide_trends(curves, [], "day", "target", ["inf_a_copies", "rsv_copies"])
    names = ",".join(sorted(wide.columns))
    flat = F.exp(0.02 * F.datediff(F.col("day"), first))
    return wide.select(
        "day", F.round(F.col("inf_a_copies_pred") / flat, 1).alias("inf_a_start"), F.round(F.col("rsv_copies_pred") / flat, 1).alias("rsv_start"),
        F.round("inf_a_fst_deriv", 4).alias("inf_a_fst_deriv"), F.round("rsv_fst_deriv", 4).alias("rsv_fst_deriv"), F.lit(names).alias("names"),
    )

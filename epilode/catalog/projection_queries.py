"""Projections, headers, filters, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import nested_rules, query
from epilode.catalog.towns import PART_TOWNS_SQL, part_towns
from epilode.functions import fixed_values as V
from epilode.functions import geometry as G
from epilode.functions.text import blank_to_null, correct_town, title_case
from epilode.operators import columns as C
from epilode.operators.joins import drop_members, join_back, keep_members, left_lookup, member_flag, triage_cases
from epilode.plans.layers import location_class, outside_code
from epilode.plans.reports import clean_report


@query(
    "prj_select_rename",
    """
    SELECT c_custkey AS geoid_county, c_name AS name_county, c_acctbal AS area_land, c_mktsegment AS location FROM customer
    """,
)
def _rename(t):
    out = t.customer.select(F.col("c_custkey").alias("geoid_county"), "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    out = out.withColumnsRenamed({"c_name": "name_county", "c_mktsegment": "location", "c_acctbal": "area_land"})
    return C.move_last(out.drop("c_nationkey"), "location")


@query(
    "prj_select_range",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def _range(t):
    return C.select_range(t.lineitem, "l_quantity", "l_tax", ["l_orderkey", "l_linenumber"])


@query(
    "prj_clean_names",
    """
    SELECT c_custkey AS customer_key, c_name AS name_2, c_mktsegment AS name, c_acctbal AS percent_balance,
           c_nationkey AS x1st_nation_code FROM customer
    """,
)
def _clean_names(t):
    return C.clean_names(
        t.customer.select("c_custkey", "c_mktsegment", "c_name", "c_acctbal", "c_nationkey").toDF(
            "CustomerKey", "Name", "NAME ", "% Balance", "1st nation-code"
        )
    )


@query(
    "prj_strip_headers",
    'SELECT o_orderkey AS "OrderNo", o_orderstatus AS "StatusopenAorclosed", o_totalprice AS "Totalamount" FROM orders',
)
def _strip(t):
    return C.strip_headers(
        t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").toDF(
            "Order No?", "Status: (open/A-or 'closed')", "Total - amount"
        )
    )


def _report(t):
    """Suppliers as a report whose second column repeats the first."""
    balance = F.floor(F.abs("s_acctbal")).cast("int")
    date = F.concat(
        (1 + balance % 12).cast("string"), F.lit("/"), (1 + balance % 28).cast("string"), F.lit("/2023"),
        F.when(balance % 2 == 0, F.concat(F.lit(" "), (1 + balance % 12).cast("string"), F.lit(":05 PM"))).otherwise(F.lit("")),
    )
    return t.supplier.select(
        F.col("s_suppkey").alias("Case No."), F.col("s_suppkey").alias("Case #2"), date.alias("Open Date"),
        F.concat(F.lit(" Oaklawn Hts, Il "), "s_name").alias("Home City"),
        F.concat(F.lit("Mt "), "s_name").alias("Ethnicity"), F.concat(F.lit("Mt "), "s_name").alias("Race"),
    )


_REPORT_SQL = f"""
    WITH b AS (SELECT *, CAST(floor(abs(s_acctbal)) AS INTEGER) AS k FROM supplier),
         r AS (SELECT s_suppkey,
                 make_timestamp(2023, 1 + k % 12, 1 + k % 28,
                                CASE WHEN k % 2 = 0 THEN (1 + k % 12) % 12 + 12 ELSE 0 END,
                                CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END, 0) AS opened,
                 trim(' Oaklawn Hts, Il ' || s_name) AS town, 'Mt ' || s_name AS raw FROM b)
"""


@query(
    "prj_across_contains",
    _REPORT_SQL + f"""
    SELECT s_suppkey AS "Case No.", s_suppkey AS "Case #2", {nested_rules('town', V.TOWN_CORRECTIONS)} AS "Home City",
           {nested_rules('raw', V.TOWN_CORRECTIONS)} AS "Ethnicity", raw AS "Race" FROM r
    """,
)
def _across(t):
    return C.across_contains(_report(t), "City", correct_town).drop("Open Date")


@query(
    "prj_clean_report",
    _REPORT_SQL + f"""
    SELECT s_suppkey AS "CaseNo.", opened AS "OpenDate", {nested_rules('town', V.TOWN_CORRECTIONS)} AS "HomeCity",
           {nested_rules('raw', V.TOWN_CORRECTIONS)} AS "Ethnicity", raw AS "Race" FROM r
    """,
)
def _clean_report(t):
    return clean_report(_report(t))


@query(
    "prj_drop_position",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def _drop_position(t):
    return C.drop_position(t.orders, 2)


@query(
    "prj_unnest",
    """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS match_address,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS score FROM customer
    """,
)
def _unnest(t):
    found = F.when(
        F.col("c_acctbal") >= 0,
        F.array(F.struct(F.col("c_name").alias("match_address"), F.col("c_acctbal").alias("score"))),
    )
    return C.unnest(t.customer.select("c_custkey", found.alias("result")), "result")


@query("prj_drop_geometry", "SELECT p_partkey, p_name FROM part")
def _drop_geometry(t):
    x = F.col("p_size").cast("double")
    layer = t.part.select("p_partkey", "p_name", G.box(x, x, x + 1, x + 1).alias("geom"), F.lit(3435).alias("srid"))
    return C.drop_geometry(layer)


@query(
    "prj_time_series",
    """
    SELECT CAST(ts AS DATE) AS date, count(*) AS count, event_type AS name FROM events GROUP BY ALL
    """,
)
def _series(t):
    # All series lie in one landed table, so one pass reads them.
    feed = t.events.groupBy(F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return C.time_series(feed, ["date", "count", "name"])


@query(
    "flt_predicates",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE (l_returnflag = 'R' OR l_shipdate < TIMESTAMP '1996-01-01') AND l_linenumber IN (1, 2, 3)
      AND l_linestatus IS NOT NULL AND l_quantity >= 10
    """,
)
def _predicates(t):
    return t.lineitem.filter(
        ((F.col("l_returnflag") == "R") | (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
        & F.col("l_linenumber").isin(1, 2, 3)
        & F.col("l_linestatus").isNotNull()
        & (F.col("l_quantity") >= 10)
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "flt_suffix",
    "SELECT event_id, upper(event_type) AS variable FROM events WHERE right(upper(event_type), 1) IN ('E', 'M')",
)
def _suffix(t):
    return C.keep_estimates(t.events.select("event_id", F.upper("event_type").alias("variable")), "variable")


@query(
    "flt_drop_na",
    f"WITH {PART_TOWNS_SQL} SELECT p_partkey, town, zip FROM dirty WHERE town IS NOT NULL AND zip IS NOT NULL",
)
def _drop_na(t):
    return part_towns(t).select("p_partkey", "town", "zip").dropna(subset=["town", "zip"])


@query(
    "flt_blank_tokens",
    f"""
    WITH {PART_TOWNS_SQL} SELECT p_partkey, CASE WHEN town = 'unknown' THEN NULL
      ELSE array_to_string(list_transform(string_split(lower(town), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS town
    FROM dirty
    """,
)
def _blank(t):
    return part_towns(t).select("p_partkey", blank_to_null(title_case(F.col("town"))).alias("town"))


@query(
    "flt_discard_failed",
    "SELECT o_orderkey, o_totalprice AS estimate FROM orders WHERE o_orderstatus <> 'P'",
)
def _discard(t):
    status = F.when(F.col("o_orderstatus") == "P", F.lit("The call failed")).otherwise(F.lit("ok"))
    good, _ = C.discard_failed(t.orders.select("o_orderkey", F.col("o_totalprice").alias("estimate"), status.alias("status")))
    return good.drop("status")


@query(
    "prj_member_flag",
    """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_open FROM customer
    """,
)
def _member(t):
    return member_flag(
        t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_orderstatus = 'P'"), "o_custkey", "has_open"
    )


_PLANT_CASE = "\n".join(f"WHEN regexp_matches(plant, '{p}') THEN '{s}'" for p, _, s in V.PLANTS)
_DISPLAY_CASE = "\n".join(
    "WHEN regexp_matches(plant, '{0}') THEN '{1}'".format(p, d.replace("'", "''")) for p, d, _ in V.PLANTS
)


@query(
    "prj_case_relabel",
    f"""
    WITH p AS (SELECT p_partkey, lower(CASE p_type WHEN 'ECONOMY' THEN 'Stickney SWS ' WHEN 'STANDARD' THEN 'Stickney WS '
                 WHEN 'PROMO' THEN 'Lemont ' WHEN 'SMALL' THEN 'Terrence J. O''Brien ' WHEN 'LARGE' THEN 'Egan ' ELSE 'Other ' END || p_name) AS plant FROM part)
    SELECT p_partkey, CASE {_DISPLAY_CASE} END AS display_name, CASE {_PLANT_CASE} END AS short_name FROM p
    """,
)
def _relabel(t):
    names = F.create_map(*[
        F.lit(x) for x in ("ECONOMY", "Stickney SWS ", "STANDARD", "Stickney WS ", "PROMO", "Lemont ",
                           "SMALL", "Terrence J. O'Brien ", "LARGE", "Egan ", "MEDIUM", "Other ")
    ])
    plant = F.lower(F.concat(names[F.col("p_type")], "p_name"))
    return t.part.select(
        "p_partkey",
        C.relabel(plant, [(p, d) for p, d, _ in V.PLANTS]).alias("display_name"),
        C.relabel(plant, [(p, s) for p, _, s in V.PLANTS]).alias("short_name"),
    )


@query(
    "prj_if_else",
    """
    WITH d AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Outside' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END AS d,
                      CASE WHEN c_acctbal > 5000 THEN 'Chicago' ELSE c_name END AS town FROM customer),
         e AS (SELECT *, CASE WHEN d = 'Outside' THEN 'OOJ' ELSE d END AS district FROM d)
    SELECT c_custkey, district,
           CASE WHEN district = 'OOJ' AND town <> 'Chicago' THEN 'SCC' WHEN district = 'OOJ' THEN 'Chicago'
                WHEN district <> 'OOJ' THEN 'LOCAL' END AS location FROM e
    """,
)
def _if_else(t):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Outside")).when(
        F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")
    )
    town = F.when(F.col("c_acctbal") > 5000, F.lit("Chicago")).otherwise(F.col("c_name"))
    rows = t.customer.select("c_custkey", outside_code(raw).alias("district"), town.alias("town"))
    return rows.select("c_custkey", "district", location_class(F.col("district"), F.col("town")).alias("location"))


@query(
    "prj_case_triage",
    """
    WITH r AS (SELECT o_orderkey AS case_number, r_name AS jurisdiction,
                 CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'In progress' END AS st,
                 CASE WHEN o_totalprice > 250000 THEN c_name ELSE '' END AS cur,
                 CASE o_orderpriority WHEN '1-URGENT' THEN ' ' WHEN '5-LOW' THEN 'nobody' ELSE c_name END AS req,
                 o_orderpriority = '2-HIGH' AS overwrite
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
         o AS (SELECT *, CASE WHEN jurisdiction <> 'ASIA' THEN 'transferred' WHEN st = 'Closed' THEN 'closed'
                  WHEN NOT overwrite AND cur <> '' THEN 'already assigned' WHEN req = ' ' THEN 'cleared'
                  WHEN req = 'nobody' THEN 'unknown investigator' ELSE 'assigned' END AS outcome FROM r)
    SELECT case_number, outcome, case_number || CASE outcome WHEN 'transferred' THEN ' has been transferred to ' || jurisdiction
       WHEN 'closed' THEN ' has been Closed' WHEN 'already assigned' THEN ' already assigned'
       WHEN 'unknown investigator' THEN ' not assigned' ELSE ' assigned to ' || req END AS message FROM o
    """,
)
def _triage(t):
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    status = F.when(F.col("o_orderstatus") == "F", F.lit("Closed")).when(
        F.col("o_orderstatus") == "O", F.lit("Open")).otherwise(F.lit("In progress"))
    cases = rows.select(
        F.col("o_orderkey").alias("case_number"), F.col("r_name").alias("jurisdiction"), status.alias("investigation_status"),
        F.when(F.col("o_totalprice") > 250000, F.col("c_name")).otherwise(F.lit("")).alias("current_investigator"),
    )
    wanted = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" ")).when(
        F.col("o_orderpriority") == "5-LOW", F.lit("nobody")).otherwise(F.col("c_name"))
    requests = rows.select(
        F.col("o_orderkey").alias("case_number"), wanted.alias("requested_investigator"),
        (F.col("o_orderpriority") == "2-HIGH").alias("overwrite"),
    )
    return triage_cases(cases, requests, t.customer.select(F.col("c_name").alias("investigator")), "ASIA")


@query(
    "join_left_equi",
    """
    SELECT n_name, s_suppkey, s_acctbal FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON n_nationkey = s_nationkey
    """,
)
def _left(t):
    rows = left_lookup(t.nation, t.supplier.filter("s_acctbal > 0"), {"n_nationkey": "s_nationkey"})
    return rows.select("n_name", "s_suppkey", "s_acctbal")


@query(
    "join_back_by_id",
    """
    SELECT c_custkey, x AS "X", n AS score, 'SUCCESS' AS geo_status
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
    """,
)
def _back(t):
    results = t.orders.groupBy(F.col("o_custkey").alias("OBJECTID")).agg(
        F.max("o_totalprice").alias("X"), F.count(F.lit(1)).alias("score")
    )
    return join_back(t.customer.select("c_custkey"), results, "c_custkey")


@query(
    "join_semi_member",
    """
    SELECT 'in' AS part, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL
    SELECT 'out', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    """,
)
def _semi(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    one = keep_members(t.customer, "c_custkey", urgent, "o_custkey").select(F.lit("in").alias("part"), "c_custkey")
    two = drop_members(t.customer, "c_custkey", urgent, "o_custkey").select(F.lit("out").alias("part"), "c_custkey")
    return one.unionByName(two)

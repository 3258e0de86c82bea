"""Census tables and jurisdiction estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import query
from epilode.plans.census import estimates_table, jurisdiction_estimate, with_sex_age


@query(
    "agg_acs_table",
    """
    SELECT c_name AS "NAME", 'B0' || k || 'E' AS variable, CASE WHEN c_nationkey = 3 THEN NULL ELSE CAST(floor(c_acctbal) * k AS DOUBLE) END AS estimate,
           CAST(c_nationkey AS VARCHAR) AS moe, CASE k WHEN 1 THEN 'Estimate!!Total' END AS label,
           CASE k WHEN 1 THEN 'AGE' END AS concept, CAST(c_custkey // 500 AS VARCHAR) AS census_place_code
    FROM customer, (SELECT unnest([1, 2]) AS k)
    """,
)
def _acs(t):
    # Each response holds two variables with margin and annotations.
    balance = F.floor("c_acctbal")
    value = F.when(F.col("c_nationkey") == 3, F.lit("N"))
    cells = [
        F.col("c_name"), F.col("c_custkey").cast("string"),
        F.coalesce(value, balance.cast("string")), F.col("c_nationkey").cast("string"), F.lit("(X)"), F.lit("(X)"),
        F.coalesce(value, (balance * 2).cast("string")), F.col("c_nationkey").cast("string"), F.lit("17"), F.lit("14000"),
    ]
    head = ["NAME", "GEO_ID", "B01E", "B01M", "B01EA", "B01MA", "B02E", "B02M", "state", "place"]
    landed = t.customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("code")).agg(
        F.to_json(F.concat(F.array(F.array(*[F.lit(h) for h in head])), F.collect_list(F.array(*cells)))).alias("payload")
    )
    labels = t.spark.createDataFrame([("B01E", "Estimate!!Total", "AGE")], "name string, label string, concept string")
    return estimates_table(landed, "payload", "code", labels)


_UNITS_SQL = """
    units AS (SELECT 'county' AS geography, r_name AS name, o_orderpriority AS variable, CAST(count(*) AS DOUBLE) AS value, r_name AS cut
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
              GROUP BY r_name, o_orderpriority
              UNION ALL
              SELECT CASE WHEN n_nationkey > 19 THEN 'county subdivision' ELSE 'place' END, n_name, o_orderpriority, count(*), NULL
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
              GROUP BY n_nationkey, n_name, o_orderpriority)
"""


def _units(t):
    """Orders per region (county) and nation (place or subdivision), one variable per priority."""
    base = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_nationkey", "n_name", "n_regionkey", F.col("o_orderpriority").alias("variable"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    kind = F.when(F.col("n_nationkey") > 19, F.lit("county subdivision")).otherwise(F.lit("place"))
    small = base.select(kind.alias("geography"), F.col("n_name").alias("name"), "variable", "value")
    large = (
        base.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("name"), "variable").agg(F.sum("value").alias("value"))
        .select(F.lit("county").alias("geography"), "name", "variable", "value")
    )
    return small.unionByName(large)


_PLACES = ["NATION_1", "NATION_6", "NATION_11", "NATION_16"]
_ESTIMATE_SQL = f"""
    SELECT variable, sum(value) FILTER (geography = 'county' AND name = 'AMERICA')
         - coalesce(sum(value) FILTER (geography = 'place' AND name IN ({', '.join(repr(p) for p in _PLACES)})), 0)
         - sum(value) FILTER (geography = 'county subdivision' AND name = 'NATION_21') AS population
    FROM units GROUP BY variable
"""


@query("agg_jurisdiction", f"WITH {_UNITS_SQL} {_ESTIMATE_SQL}")
def _jurisdiction(t):
    return jurisdiction_estimate(_units(t), "AMERICA", _PLACES, "NATION_21")


@query(
    "agg_jurisdiction_many",
    f"""
    WITH {_UNITS_SQL}, e AS ({_ESTIMATE_SQL}),
      l AS (SELECT DISTINCT o_orderpriority AS name, 'Total!!' || CASE WHEN o_orderpriority < '3' THEN 'Male!!' ELSE 'Female!!' END || o_orderpriority AS label FROM orders)
    SELECT label AS "group", CASE WHEN label LIKE '%Female%' THEN 'Female' ELSE 'Male' END AS sex, e.variable AS age, population
    FROM e LEFT JOIN l ON e.variable = l.name
    """,
)
def _many(t):
    estimates = jurisdiction_estimate(_units(t), "AMERICA", _PLACES, "NATION_21")
    name = F.col("o_orderpriority")
    labels = t.orders.select(name).distinct().select(
        name.alias("name"),
        F.concat(F.lit("Total!!"), F.when(name < "3", F.lit("Male!!")).otherwise(F.lit("Female!!")), name).alias("label"),
    )
    return with_sex_age(estimates, labels)

"""Set operations and gazetteer construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilode.catalog.registry import query
from epilode.operators import sets as S


@query(
    "set_union_all",
    """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
    """,
)
def _union_all(t):
    return S.bind_rows(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")),
    )


@query(
    "set_union_distinct",
    """
    SELECT p_name AS area FROM part UNION SELECT p_brand || CASE WHEN p_size > 25 THEN ', ' || p_type ELSE '' END FROM part
    WHERE p_size <= 25
    """,
)
def _union_distinct(t):
    lists = t.part.select(
        F.concat("p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit(", "), "p_type")).otherwise(F.lit(""))).alias("b")
    )
    return S.union_distinct(t.part, "p_name", lists, "b")


@query(
    "set_except",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def _except(t):
    return S.set_except(
        t.customer.select(F.col("c_custkey").alias("id")),
        t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")),
    )


@query("set_distinct", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders")
def _distinct(t):
    return t.orders.select(F.to_date("o_orderdate").alias("day"), "o_orderstatus").distinct()


@query(
    "set_add_row",
    "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT NULL, 'Hines'",
)
def _add_row(t):
    return S.add_row(t.supplier.select("s_suppkey", "s_name"), s_name="Hines")


@query(
    "set_gazetteer_build",
    """
    SELECT 'city' AS list, city AS name, city IN (SELECT p_name FROM part WHERE p_size > 45) OR city = 'Chicago' AS flag
    FROM (SELECT DISTINCT p_name AS city FROM part)
    UNION ALL SELECT 'city', 'Hines', TRUE
    UNION ALL
    SELECT 'zip', lpad((c_custkey % 100000)::VARCHAR, 5, '0'),
           lpad((c_custkey % 100000)::VARCHAR, 5, '0') IN (SELECT lpad((o_custkey % 100000)::VARCHAR, 5, '0') FROM orders)
    FROM customer
    """,
)
def _gazetteer(t):
    kind = F.when(F.col("p_size") > 40, F.lit(" village")).when(F.col("p_size") > 30, F.lit(" CDP")).otherwise(F.lit(" city"))
    places = t.part.select(F.concat("p_name", kind, F.lit(", Illinois")).alias("NAME"))
    cities = S.build_city_list(places, "NAME", t.part.filter("p_size > 45"), "p_name").select(
        F.lit("city").alias("list"), F.col("city").alias("name"), F.col("in_cook").alias("flag")
    )

    def zip_text(key):
        return F.lpad((F.col(key) % 100000).cast("string"), 5, "0")

    zctas = t.customer.select(F.concat(F.lit("17"), zip_text("c_custkey")).alias("GEOID"))
    zips = S.build_zip_list(zctas, "GEOID", t.orders.select(zip_text("o_custkey").alias("z")), "z").select(
        F.lit("zip").alias("list"), F.col("zip").alias("name"), F.col("subcook").alias("flag")
    )
    return cities.unionByName(zips)

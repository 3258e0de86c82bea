"""Lookups, membership, decisions over joined rows.

No join carries a broadcast hint: the reference side is small today, and the
optimizer and AQE broadcast it while its size, estimated or measured, is below
`spark.sql.autoBroadcastJoinThreshold`; above it the same plan shuffles and
splits hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys meet each other; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def left_lookup(df: DataFrame, ref: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join with differing key names {left: right}; repeats on the right multiply rows."""
    renamed = ref.withColumnsRenamed({r: f"__{r}" for r in on.values()})
    cond = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"__{r}") for l, r in on.items()])
    return df.join(renamed, cond, "left").drop(*[f"__{r}" for r in on.values()])


def join_back(df: DataFrame, results: DataFrame, id_field: str, result_id: str = "OBJECTID",
              status: str = "SUCCESS") -> DataFrame:
    """Results joined to their input rows, with the status of the call."""
    return left_lookup(df, results, {id_field: result_id}).withColumn("geo_status", F.lit(status))


def keep_members(df: DataFrame, col: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """Rows whose value is in the reference list."""
    return df.join(ref.select(F.col(ref_col).alias("__m")), F.col(col) == F.col("__m"), "left_semi")


def drop_members(df: DataFrame, col: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """Rows whose value is not in the reference list (missing values stay)."""
    return df.join(ref.select(F.col(ref_col).alias("__m")), F.col(col) == F.col("__m"), "left_anti")


def member_flag(df: DataFrame, col: str, ref: DataFrame, ref_col: str, flag: str) -> DataFrame:
    """Boolean membership column, FALSE for missing values."""
    members = ref.select(F.col(ref_col).alias("__m")).distinct()
    return df.join(members, F.col(col) == F.col("__m"), "left").withColumn(
        flag, F.col("__m").isNotNull()
    ).drop("__m")


def city_in_zip(df: DataFrame, town: str, zip_code: str, city_zips: DataFrame, flag: str = "in_zip") -> DataFrame:
    """Is (zip, town) a known pair?  NULL when either is missing."""
    known = city_zips.select(F.col("zip").alias("__z"), F.col("city").alias("__c")).distinct()
    return (
        df.join(known, (F.col(zip_code) == F.col("__z")) & (F.col(town) == F.col("__c")), "left")
        .withColumn(
            flag,
            F.when(F.col(town).isNotNull() & F.col(zip_code).isNotNull(), F.col("__z").isNotNull()),
        )
        .drop("__z", "__c")
    )


def single_city_zips(city_zips: DataFrame) -> DataFrame:
    """(zip, only_city) for zips listed with exactly one city."""
    return (
        city_zips.groupBy("zip")
        .agg(F.count(F.lit(1)).alias("n"), F.min("city").alias("only_city"))
        .filter("n = 1")
        .drop("n")
    )


def triage_cases(cases: DataFrame, requests: DataFrame, investigators: DataFrame,
                 home_jurisdiction: str) -> DataFrame:
    """What an assignment request leads to, first matching rule wins.

    cases(case_number, jurisdiction, investigation_status, current_investigator),
    requests(case_number, requested_investigator, overwrite),
    investigators(investigator).  A blank request clears the investigator.
    """
    known = investigators.select(F.col("investigator").alias("__i")).distinct()
    rows = requests.join(cases, "case_number").join(
        known, F.col("requested_investigator") == F.col("__i"), "left"
    )
    blank = F.col("requested_investigator").isin("", " ")
    taken = F.coalesce(F.col("current_investigator"), F.lit("")) != ""
    case = F.col("case_number").cast("string")

    def rule(outcome: str, *message: Column) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.concat(*message).alias("message"))

    decided = (
        F.when(F.col("jurisdiction") != home_jurisdiction,
               rule("transferred", case, F.lit(" has been transferred to "), F.col("jurisdiction")))
        .when(F.col("investigation_status").isin(V.CLOSED_STATUSES), rule("closed", case, F.lit(" has been Closed")))
        .when(~F.col("overwrite") & taken, rule("already assigned", case, F.lit(" already assigned")))
        .when(blank, rule("cleared", case, F.lit(" assigned to "), F.col("requested_investigator")))
        .when(F.col("__i").isNull(), rule("unknown investigator", case, F.lit(" not assigned")))
        .otherwise(rule("assigned", case, F.lit(" assigned to "), F.col("requested_investigator")))
    )
    return rows.withColumn("__d", decided).select("case_number", "__d.outcome", "__d.message")

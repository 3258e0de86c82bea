"""Operators that depend on row order: firsts, next values, numbering, samples."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilode.functions import fixed_values as V
from epilode.functions.measures import interval_label, interval_start
from epilode.functions.nulls import strict_count_if
from epilode.operators.aggregates import attach
from epilode.operators.joins import null_safe_join
from epilode.session import cut_lineage


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per group.

    Written as rank = 1, for which the optimizer keeps one row per key and map
    task before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def keep_complete(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of groups that have exactly `size` rows."""
    full = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size)
    full = cut_lineage(full.select(F.col(key).alias("__k")), "complete")
    return df.join(full, F.col(key).eqNullSafe(F.col("__k")), "left_semi")


def with_group_size(df: DataFrame, key: str, out: str = "num_sites") -> DataFrame:
    """Group row count on every row."""
    return attach(df, [key], **{out: F.count(F.lit(1))})


def late_dates(df: DataFrame, site: str, date: str, late_site: str, others: int) -> DataFrame:
    """Days after those on which all `others` but the late site reported."""
    counts = df.groupBy(date).agg(strict_count_if(F.col(site) != late_site).alias("__n"))
    return counts.filter(F.col("__n") == others).select(F.date_add(date, 1).alias("late_date"))


def align_late_site(df: DataFrame, dates: DataFrame, site: str, date: str, late_site: str) -> DataFrame:
    """Move the late site's sample back one day on the given dates."""
    marks = cut_lineage(dates.select("late_date").distinct(), "late_dates")
    moved = df.join(
        marks, (F.col(date) == F.col("late_date")) & (F.col(site) == late_site), "left"
    )
    return moved.withColumn(
        date, F.when(F.col("late_date").isNotNull(), F.date_sub(date, 1)).otherwise(F.col(date))
    ).drop("late_date")


def label_levels(levels: DataFrame, label: str = "interval", code: str = "code") -> DataFrame:
    """Display text of ordered interval levels; each needs the next one's start.

    The next level is the one that follows in order, whatever its code.  `levels` is
    the list of a factor's levels, not its rows, so one task can order it.
    """
    starts = levels.select(label, code, interval_start(F.col(label)).alias("__s")).distinct()
    following = F.lead("__s").over(Window.orderBy(code))
    return starts.select(label, code, interval_label(F.col("__s"), following).alias("pretty"))


def next_day_delta(df: DataFrame, keys: list[str], date: str, value: str, out: str = "delta") -> DataFrame:
    """value(day + 1) - value(day) of a daily series; NULL where the next day is missing."""
    following = df.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.date_sub(date, 1).alias("__d"),
        F.col(value).alias("__v"),
    )
    cond = F.col(date) == F.col("__d")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        df.join(following, cond, "left")
        .withColumn(out, F.col("__v") - F.col(value))
        .drop("__d", "__v", *[f"__{k}" for k in keys])
    )


# Ranges into which keys are cut for numbering, keys that the cuts are taken from,
# and parts into which the rows of one key fall.
_RANGES, _CUT_SAMPLE, _SALTS = 256, 10_000, 64


def _range_of(key: Column, cuts: list, first: int = 0) -> Column:
    """How many of the sorted cuts lie below the key, found by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(key <= F.lit(cuts[half]), _range_of(key, cuts[:half], first)).otherwise(
        _range_of(key, cuts[half + 1 :], first + half + 1)
    )


def number_rows(df: DataFrame, key: str, out: str = "row_id") -> DataFrame:
    """Consecutive numbers from 1 in key order, without a one-task sort or a copy.

    Keys are cut into ranges at quantiles of a sample; any cuts are correct, good ones
    make ranges of like size.  Rows are counted by key and a hash of the whole row, so
    that the rows of a frequent key fall into several parts.  The counts are summed up
    within a range, and those of the ranges before are added.  Missing keys come first.
    Rows of a key follow two hashes of all their columns, so a task that runs again, or
    another number of partitions, gives every row the same number; only equal rows may
    change places.
    """
    k = F.col(key)
    sample = df.select(k.alias("k")).filter("k IS NOT NULL").orderBy(F.xxhash64("k")).limit(_CUT_SAMPLE).collect()
    ordered = sorted(r["k"] for r in sample)
    cuts = sorted({ordered[len(ordered) * i // _RANGES] for i in range(1, _RANGES)}) if ordered else []
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
    parts = salted.groupBy(key, "__salt").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__range", F.when(k.isNull(), F.lit(-1)).otherwise(_range_of(k, cuts))
    )
    # A row per range; the driver adds them up.
    sizes = parts.groupBy("__range").agg(F.sum("__n").alias("n")).orderBy("__range").collect()
    before = [0, *accumulate(r["n"] for r in sizes)][: len(sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(r["__range"], b) for r, b in zip(sizes, before)], "__range int, __before bigint"
    )
    earlier = Window.partitionBy("__range").orderBy(k.asc_nulls_first(), "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(offsets, "__range").select(
        key, "__salt", (F.col("__start") + F.col("__before")).alias("__start")
    )
    whole = [F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)]
    within = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*whole))
    numbered = null_safe_join(salted.withColumn("__pos", within), starts, [key, "__salt"])
    return numbered.withColumn(out, F.col("__start") + F.col("__pos")).drop("__pos", "__start", "__salt")


def batch_id(row_id: Column, limit: int = V.BATCH_LIMIT) -> Column:
    """Batch of a 1-based row number; the first batch has one row less."""
    return F.floor(row_id / limit)


def latest(df: DataFrame, time: str, n: int = 1) -> DataFrame:
    """The `n` newest rows."""
    return df.orderBy(F.col(time).desc_nulls_last()).limit(n)


def argmin(df: DataFrame, keys: list[str], value: str, order: str, columns: list[str]) -> DataFrame:
    """Columns of the row with the least value per group, first in order on a tie."""
    pick = F.min_by(F.struct(*columns), F.struct(value, order))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(pick.alias("__p")).select(*keys, "__p.*")


def sample_order(key: Column, seed: int) -> Column:
    """Text that orders rows at random, the same way in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """`n` rows at random, the same ones for the same seed.

    Rows are ordered by a hash of their key; each task keeps its first `n`.
    """
    return df.orderBy(sample_order(F.col(key), seed), key).limit(n)

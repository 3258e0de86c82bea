"""Aggregates.

Group statistics that go back to the rows are computed by a partial/final
aggregate and joined back, not by a window: a window sorts each group in one
task, which fails when a group holds a large part of the rows.  The statistics
are written first, so the planner knows their size when it joins them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilode.functions.nulls import ratio, strict_count_if, strict_mean, strict_sum
from epilode.operators.joins import null_safe_join
from epilode.session import cut_lineage


def attach(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Attach group statistics to every row; missing keys form a group."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return null_safe_join(df, cut_lineage(totals, "group_stats"), keys)


def add_share(df: DataFrame, n: str = "n", by: list[str] | None = None, out: str = "proportion") -> DataFrame:
    """Percent of the total (per group), one decimal; one missing `n` voids its group."""
    total = strict_sum(F.col(n))
    if by:
        rows = attach(df, by, __total=total)
        return rows.withColumn(out, F.bround(ratio(F.col(n), F.col("__total")) * 100, 1)).drop("__total")
    whole = df.agg(total.alias("t")).scalar()
    return df.withColumn(out, F.bround(ratio(F.col(n), whole) * 100, 1))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Count and percent of rows per value; missing values only count in the base."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.bround(F.col("n") / rows * 100, 1)).filter(F.col(col).isNotNull())


def count_if(df: DataFrame, keys: list[str], pred: Column, out: str = "n") -> DataFrame:
    """Rows per group satisfying `pred`; NULL if it is unknown for one of them."""
    return df.groupBy(*keys).agg(strict_count_if(pred).alias(out))


def first_per_group(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the first row of each group in the given order."""
    pick = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__first")).select(*keys, "__first.*")


def site_means(df: DataFrame, site: str, columns: dict[str, str]) -> DataFrame:
    """Mean of each column per site, NULL if a value is missing; {column: name}."""
    return df.groupBy(site).agg(*[strict_mean(F.col(c)).alias(n) for c, n in columns.items()])


# Equal parts of the bracket around a median.
_PARTS = 1024


def median_sd(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and sample deviation per group, missing values skipped.

    A sketch brackets the median first.  The values inside the bracket (about one in
    250 of a large group) are counted in equal parts of it, and only the one or two
    parts that hold the middle are ranked, so no task holds a fixed share of a group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    stats = cut_lineage(
        rows.groupBy(*keys).agg(
            F.percentile_approx("v", [0.499, 0.501], 10_000).alias("br"),
            F.count("v").alias("n"),
            F.stddev_samp("v").alias("sd"),
        ),
        "median_bracket",
    )
    v, br = F.col("v"), F.col("br")
    # Values outside the bracket are only counted, those inside kept apart.
    counted = cut_lineage(
        null_safe_join(rows, stats.select(*keys, "br"), keys)
        .filter(v <= br[1])
        .groupBy(*keys, F.when(v >= br[0], v).alias("v"))
        .agg(F.count(F.lit(1)).alias("c")),
        "median_counts",
    )
    below = counted.filter("v is null").select(*keys, F.col("c").alias("below"))
    r1, r2 = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    base = null_safe_join(stats.select(*keys, "n", "br"), below, keys).fillna(0, ["below"])
    # The bracket in equal parts; only the parts that hold the middle ranks are sorted.
    width = (br[1] - br[0]) / _PARTS
    part = F.when(width > 0, F.least(F.floor((v - br[0]) / width), F.lit(_PARTS - 1))).otherwise(F.lit(0)).cast("int")
    inner = cut_lineage(
        null_safe_join(counted.filter("v is not null"), base, keys).withColumn("part", part).drop("br"), "median_parts"
    )
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inner.groupBy(*keys, "part", "n", "below").agg(F.sum("c").alias("c")).withColumn(
        "before", F.coalesce(F.sum("c").over(earlier), F.lit(0)) + F.col("below")
    )
    holds = [(F.col("before") < r) & (r <= F.col("before") + F.col("c")) for r in (r1, r2)]
    chosen = cut_lineage(parts.filter(holds[0] | holds[1]).select(*keys, "part", "before"), "median_chosen")
    w = Window.partitionBy(*keys, "part").orderBy("v")
    near = null_safe_join(inner, chosen, [*keys, "part"], "inner")
    ranked = near.withColumn("cum", F.sum("c").over(w) + F.col("before")).withColumns(
        {"lo": F.col("cum") - F.col("c"), "hi": F.col("cum")}
    )
    middle = ranked.groupBy(*keys).agg(
        (
            (F.max(F.when((F.col("lo") < r1) & (r1 <= F.col("hi")), F.col("v")))
             + F.max(F.when((F.col("lo") < r2) & (r2 <= F.col("hi")), F.col("v")))) / 2
        ).alias("median")
    )
    return null_safe_join(stats.select(*keys, "n", "sd"), middle, keys).select(*keys, "n", "median", "sd")


def sample_support(df: DataFrame, keys: list[str], date: str, target: str, per_basis: int = 5) -> DataFrame:
    """Distinct dates, missing targets, usable samples and the largest basis per group."""
    # Two plain aggregation levels instead of a distinct aggregate.
    daily = df.groupBy(*keys, date).agg(F.count_if(F.col(target).isNull()).alias("m"))
    return daily.groupBy(*keys).agg(
        F.count(date).alias("n_dates"), F.sum("m").alias("n_missing")
    ).withColumn("n_samples", F.col("n_dates") - F.col("n_missing")).withColumn(
        "k_max", F.floor(F.col("n_samples") / per_basis).cast("int")
    )


def to_long(df: DataFrame, ids: list[str], columns: list[str], variable: str = "variable",
            value: str = "value") -> DataFrame:
    """Columns to (variable, value) rows."""
    return df.unpivot(ids, columns, variable, value)


def to_wide(df: DataFrame, ids: list[str], names: str, value: str, levels: dict[str, str]) -> DataFrame:
    """(name, value) rows to columns; `levels` maps a name to its column."""
    return df.groupBy(*ids).agg(
        *[F.max(F.when(F.col(names) == k, F.col(value))).alias(out) for k, out in levels.items()]
    )


def collect_batches(df: DataFrame, batch: str, order: str, columns: dict[str, str], out: str = "records") -> DataFrame:
    """Rows of each batch as one array sorted by `order`.

    A batch is bounded by the batch limit, so the array is too.
    """
    item = F.struct(F.col(order).alias("__o"), F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias("r"))
    arrays = df.groupBy(batch).agg(F.sort_array(F.collect_list(item)).alias("__a"))
    return arrays.select(batch, F.transform("__a", lambda x: x["r"]).alias(out))

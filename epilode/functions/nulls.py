"""Missing-value rules that differ from Spark's defaults.

The modelled aggregates return a missing value as soon as one input is missing;
Spark's skip nulls.  Divisions by zero give NULL here instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _complete(col: Column) -> Column:
    return F.count(F.lit(1)) == F.count(col)


def strict_sum(col: Column) -> Column:
    """Sum that is NULL if any input is NULL."""
    return F.when(_complete(col), F.sum(col))


def strict_mean(col: Column) -> Column:
    """Mean that is NULL if any input is NULL."""
    return F.when(_complete(col), F.avg(col))


def strict_count_if(pred: Column) -> Column:
    """Rows satisfying `pred`; NULL if the predicate is unknown for any row."""
    return F.when(_complete(pred), F.count_if(pred))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL for a zero denominator."""
    return F.try_divide(num, den)


def is_member(col: Column, *values) -> Column:
    """Membership that is FALSE, never NULL, for a NULL value."""
    return F.coalesce(col.isin(*values), F.lit(False))

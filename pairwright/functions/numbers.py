"""Cleaning of NaN and infinite numbers. In Spark, NaN and NULL are different things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def unusable_to_zero(c: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(c.isNull() | F.isnan(c) | is_infinite(c), F.lit(0.0)).otherwise(c)


def unusable_to_null(c: Column) -> Column:
    """NaN and infinities become NULL, the 'missing' of tree learners."""
    return F.when(~(F.isnan(c) | is_infinite(c)), c)

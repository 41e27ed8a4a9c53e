"""Cleaning of feature and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import winners_valid
from pairwright.functions.numbers import is_infinite, unusable_to_null, unusable_to_zero
from pairwright.operators.rows import unpivot
from pairwright.schema import WINNERS, columns_like, fractional_columns, numeric_columns, string_columns

REDUNDANT = ("cluster_id",)
CLUSTER_PREFIX = "cluster_id_k"


def clean_features(df: DataFrame, policy: str = "zero", drop: tuple[str, ...] = REDUNDANT) -> DataFrame:
    """Drop redundant columns and make every number usable.

    ``zero`` replaces NULL, NaN and infinities of numeric columns by 0; ``null`` turns NaN and
    infinities into NULL and leaves the rest alone. Topic clusters (``cluster_id_k*``) are categories: 0 is a topic like any
    other, so an unknown one stays NULL.
    """
    df = df.drop(*drop)
    fractions = fractional_columns(df)
    if policy == "null":
        return df.withColumns({c: unusable_to_null(F.col(c)) for c in fractions})
    if policy != "zero":
        raise ValueError("policy is 'zero' or 'null'")
    cleaned = df.withColumns({c: unusable_to_zero(F.col(c)) for c in fractions})
    whole = numeric_columns(df, exclude=[*fractions, *columns_like(df, prefix=CLUSTER_PREFIX)])
    return cleaned.fillna(0, subset=whole) if whole else cleaned


def cleaning_report(df: DataFrame) -> DataFrame:
    """Per numeric column: how many values are NULL, NaN or infinite. One pass over the table."""
    fractions = set(fractional_columns(df))
    columns = numeric_columns(df)
    counts = []
    for c in columns:
        col = F.col(c)
        counts += [
            F.count_if(col.isNull()).alias(f"{c}|null"),
            (F.count_if(F.isnan(col)) if c in fractions else F.count_if(F.lit(False))).alias(f"{c}|nan"),
            (F.count_if(is_infinite(col)) if c in fractions else F.count_if(F.lit(False))).alias(f"{c}|inf"),
        ]
    rows = [
        {"feature": F.lit(c), "n_null": F.col(f"`{c}|null`"), "n_nan": F.col(f"`{c}|nan`"), "n_inf": F.col(f"`{c}|inf`")}
        for c in columns
    ]
    return unpivot(df.agg(*counts), [], rows)


def clean_text(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """NULL strings become empty; numbers are never blanked."""
    return df.fillna("", subset=list(columns or string_columns(df)))


def winner_audit(df: DataFrame, winners: tuple[str, str, str] = WINNERS) -> DataFrame:
    """How many rows have exactly one winner, and how many do not."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(winners_valid(winners)).alias("n_valid"),
        F.count_if(~winners_valid(winners)).alias("n_invalid"),
    )

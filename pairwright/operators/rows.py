"""Helpers shared by the aggregating operators."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keys: Sequence[str], rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn each input row into ``len(rows)`` output rows with the given named columns."""
    structs = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return df.select(*keys, F.inline(F.array(*structs)))


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round, and turn a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def row_chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most ``most``, or of a single row that is larger."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi

"""Writers. None of them overwrites the table it reads."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame

from pairwright.sources.readers import CSV_OPTIONS


def write_csv(df: DataFrame, path: str, max_rows_per_file: int = 50_000, line_end: str = "\n") -> str:
    """Header, doubled quotes, no index column; files are bounded so that a reader can work in parallel."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("multiLine", "maxCharsPerColumn")}
    df.write.options(**options).option("lineSep", line_end).option("maxRecordsPerFile", max_rows_per_file).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    """One object per line; a NULL field is written as ``null`` instead of being left out."""
    df.write.option("ignoreNullFields", False).json(path)
    return path


def write_lines(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Text lines from a single ``value`` column (plus partition columns)."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.text(path)
    return path


def write_new_version(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write next to the older versions and return the new path.

    A job cannot replace the files it is still reading: an executor lost half way would leave neither
    the old table nor the new one.
    """
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    path = f"{root.rstrip('/')}/v-{stamp}-{uuid.uuid4().hex[:8]}"
    if fmt == "csv":
        return write_csv(df, path + ".csv")
    if fmt == "jsonl":
        return write_jsonl(df, path + ".jsonl")
    return write_parquet(df, path + ".parquet")

"""Readers: csv, parquet, JSON lines, JSON documents, text logs, and a choice by file extension."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.schema import RUN_STATE_SCHEMA, string_columns

log = logging.getLogger(__name__)

#: Doubled quotes and line breaks inside quotes, the way csv writers other than Spark produce them.
#: Every file's own line ends are found from its header, so CRLF and LF files give the same table.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "maxCharsPerColumn": -1,
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, path_filter: str | None = None) -> DataFrame:
    """A csv table whose quoted text may hold line breaks.

    State the schema: inferring it reads the whole input once more. A file with line breaks inside
    quotes cannot be split, so parallelism comes from the number of part files, which
    :func:`pairwright.sources.writers.write_csv` bounds by rows.
    """
    reader = spark.read.options(**CSV_OPTIONS)
    if path_filter:
        reader = reader.option("pathGlobFilter", path_filter)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str, schema: StructType | str = RUN_STATE_SCHEMA) -> DataFrame:
    """One JSON document per file, with the file it came from."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.withColumn("path", F.col("_metadata.file_path"))


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, path_filter: str | None = None
) -> DataFrame:
    """Choose the reader by extension; ``path`` may be a glob and ``path_filter`` narrows it by file name.

    ``.jsonl`` files hold an object per line, a ``.json`` file is one document.
    """
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema, path_filter)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path_filter:
        reader = reader.option("pathGlobFilter", path_filter)
    if name.endswith((".json", ".json.gz")):
        return reader.option("multiLine", True).json(path)
    if name.endswith((".jsonl", ".jsonl.gz")):
        return reader.json(path)
    if name.endswith((".txt", ".log")):
        return reader.text(path)
    return reader.parquet(path)


def read_optional(
    spark: SparkSession, path: str, schema: StructType | str | None = None, on_missing: str = "skip"
) -> DataFrame | None:
    """Like :func:`read_table`; a missing path gives a warning and ``None``, or an error."""
    if on_missing not in ("skip", "raise"):
        raise ValueError("on_missing is 'skip' or 'raise'")
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or on_missing == "raise":
            raise
        log.warning("%s not found, skipped", path)
        return None


def read_available(spark: SparkSession, paths: Mapping[str, str], schema: StructType | str | None = None) -> dict[str, DataFrame]:
    """The named tables that exist; absent ones are skipped with a warning."""
    found = {name: read_optional(spark, path, schema) for name, path in paths.items()}
    return {name: df for name, df in found.items() if df is not None}


def read_logs(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)\.log$", streaming: bool = False) -> DataFrame:
    """Log lines ``(run, value)``; the run name is taken from the file's path."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1000).text(path) if streaming else spark.read.text(path)
    return lines.select(F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).alias("run"), "value")


def fill_text(df: DataFrame) -> DataFrame:
    """Blank NULL strings; csv does not tell an empty string from a missing one."""
    return df.fillna("", subset=string_columns(df))

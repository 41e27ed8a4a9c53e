"""Csv files with quoted line breaks, read in byte ranges, so that one large file is read by many tasks.

Spark's text reader cuts a file into ranges of whole lines. Whether a line begins inside quotes follows from the number of quote
characters before it: the first pass counts those of every range, running sums give the parity at its start, and the second pass cuts each
range where a line begins outside quotes. Only a record that crosses a border is put together from the pieces of several ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.sources.readers import CSV_OPTIONS

#: What from_csv needs to know; the pieces it gets are single records.
_RECORD_OPTIONS = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in CSV_OPTIONS.items() if k not in ("header", "multiLine")}


def _lines(spark: SparkSession, path: str, path_filter: str | None) -> DataFrame:
    """``(range, file, start, value)``: lines in the order of their range; a carriage return stays at the end of a line."""
    reader = spark.read.option("lineSep", "\n")
    if path_filter:
        reader = reader.option("pathGlobFilter", path_filter)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return reader.text(path).select(F.xxhash64(file, start).alias("range"), file.alias("file"), start.alias("start"), "value")


def open_ranges(lines: DataFrame) -> DataFrame:
    """Per range, whether it begins inside quotes and whether its file's header ends in CRLF. One row per range; the only shuffle is of such rows."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    numbered = lines.select("range", "file", "start", quotes.alias("n"), F.endswith("value", F.lit("\r")).alias("cr"), F.monotonically_increasing_id().alias("at"))
    counted = numbered.groupBy("range", "file", "start").agg(F.sum("n").alias("quotes"), F.min_by("cr", "at").alias("cr"))
    in_file = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("range", (before % 2 == 1).alias("inside"), F.first("cr").over(in_file).alias("crlf"))


def _cut(known: dict[int, tuple[bool, bool]]):
    """Pieces of records: ``(file, start, part, value)``, where part 0 is a whole record, 1 the end of one that began in an earlier range
    and 2 the beginning of one that goes on in the next range; 3 is a range without any beginning or end. ``first`` marks a file's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, began, fresh, crlf = None, [], False, True, False

        def row(part, first=False):
            return (*current, part, "\n".join(held), first)

        def ended():
            """What is left at the end of a range."""
            return [row(2 if began else 3)] if held else []

        for batch in batches:
            names, files, starts, values = (batch.column(c) for c in ("range", "file", "start", "value"))
            quotes = pc.count_substring(values, '"').to_pylist()
            out = []
            for name, file, start, value, n in zip(names.to_pylist(), files.to_pylist(), starts.to_pylist(), values.to_pylist(), quotes):
                if (file, start) != current:
                    if current is not None:
                        out += ended()
                    if name not in known:
                        raise RuntimeError("the ranges of the two passes differ: spark.sql.files settings or the files changed in between")
                    is_open, crlf = known[name]
                    current, held, began, fresh = (file, start), [], not is_open, start == 0
                held.append(value[:-1] if crlf and value.endswith("\r") else value)
                is_open ^= bool(n % 2)
                if not is_open:
                    out.append(row(0 if began else 1, fresh))
                    held, began, fresh = [], True, False
            if out:
                yield _batch(out)
        if current is not None and (left := ended()):
            yield _batch(left)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "start", "part", "value", "first"])


def read_csv_ranges(spark: SparkSession, path: str, schema: StructType | str, path_filter: str | None = None) -> DataFrame:
    """The table that :func:`pairwright.sources.readers.read_csv` gives, from ranges of ``spark.sql.files.maxPartitionBytes``.

    Every file begins with a header. Quotes must be balanced, as csv writers leave them: a field that holds a quote is quoted. Lines may end
    in LF or, as the header does, in CRLF, which is then a plain line break inside quotes as well. Empty lines outside quotes are skipped. The input is read twice. What a task is told about ranges is a number and a flag
    for each (some 10 MB for 100 TB). A record must fit into a row.
    """
    lines = _lines(spark, path, path_filter)
    known = {r["range"]: (r["inside"], r["crlf"]) for r in open_ranges(lines).collect()}  # one entry per range, not per row
    pieces = lines.mapInArrow(_cut(known), "file string, start long, part int, value string, first boolean")
    whole = pieces.filter("part = 0").select("value", "first")
    # a record that crosses borders: the piece that begins it and all pieces up to the next one's beginning
    crossing = pieces.filter("part <> 0")
    so_far = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = crossing.withColumn("record", F.sum((F.col("part") == 2).cast("int")).over(so_far))
    together = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = together.select(F.array_join("parts.value", "\n").alias("value"), F.lit(False).alias("first"))
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    records = whole.unionByName(joined).filter("NOT first AND value <> ''")
    return records.select(F.from_csv("value", ddl, _RECORD_OPTIONS).alias("r")).select("r.*")

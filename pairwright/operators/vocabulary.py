"""A vocabulary by frequency: token counts, dense ids in a total order, and texts as ids.

Ids are exact at any size: tokens are ordered by falling count, then by the token itself, in ranges that are ranked side by side;
id 0 stands for every token outside the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.text import whitespace_tokens
from pairwright.operators.rows import row_chunks
from pairwright.schema import ID
from pairwright.session import new_path

UNKNOWN_ID = 0
#: Tokens whose ids a task looks up at a time, unless one text alone has more.
CHUNK_TOKENS = 1 << 16
SIZE = 50_000


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, n)``; every task combines its tokens before the shuffle, so a hot token is one row per task."""
    return df.select(F.explode(whitespace_tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def dense_ranks(df: DataFrame, order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its position from 0 in a total order, without ranking all rows in one task.

    Rows are cut into ranges and stored with the number of their range, so that ranks never depend on drawing the borders twice.
    A range is ranked by itself and moved by the sizes of the ranges before it, one row each.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    path = new_path(spark, "ranges")
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row per range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    ranked = stored.withColumn("_within", within).join(F.broadcast(offsets), "_range")
    return ranked.withColumn(name, F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def vocabulary(counts: DataFrame, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """``(token, n, token_id)`` of the ``size`` most frequent tokens, ids from 1; equal counts go by the token."""
    ranked = dense_ranks(counts, [F.desc("n"), F.asc("token")], "_rank", parts)
    return ranked.filter(F.col("_rank") < size).select("token", "n", (F.col("_rank") + 1).cast("int").alias("token_id"))


def encode(df: DataFrame, known: DataFrame, text: str = "text", max_len: int = 2048, keep: Sequence[str] = (ID,)) -> DataFrame:
    """``keep``, ``input_ids`` of the first ``max_len`` tokens, ``n_tokens`` and ``n_unknown`` of the whole text, row by row.

    ``known`` is a vocabulary of a bounded size and travels to the tasks; no token is shuffled. A null text has no tokens.
    """
    rows = known.select("token", "token_id").collect()  # bounded by the size of the vocabulary
    broadcast = df.sparkSession.sparkContext.broadcast(([r["token"] for r in rows], np.array([r["token_id"] for r in rows], np.int32)))
    narrow = df.select(*keep, whitespace_tokens(text).alias("_tokens"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from look_up(batches, *broadcast.value, max_len, keep)

    return narrow.mapInArrow(run, fields + "input_ids array<int>, n_tokens int, n_unknown int")


def look_up(batches: Iterator[pa.RecordBatch], tokens: Sequence[str], ids: np.ndarray, max_len: int, keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of batches with token lists as ids, a chunk of ``CHUNK_TOKENS`` at a time, so that a task's memory does not follow the rows of a batch."""
    tokens, ids = pa.array(tokens, pa.string()), np.append(ids, np.int32(UNKNOWN_ID))
    for whole in batches:
        for lo, hi in row_chunks(whole.column("_tokens").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), CHUNK_TOKENS):
            batch = whole.slice(lo, hi - lo)
            lists = batch.column("_tokens")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(lists.flatten().cast(pa.string()), value_set=tokens).fill_null(len(tokens)).to_numpy(zero_copy_only=False)
            flat = ids[at]
            ends = np.cumsum(n)
            unknown = np.concatenate([[0], np.cumsum(flat == UNKNOWN_ID)])
            place = np.arange(len(flat)) - np.repeat(ends - n, n)
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, max_len))]), pa.int32()), pa.array(flat[place < max_len]))
            columns = [batch.column(c) for c in keep] + [kept, pa.array(n.astype(np.int32)), pa.array((unknown[ends] - unknown[ends - n]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "input_ids", "n_tokens", "n_unknown"])

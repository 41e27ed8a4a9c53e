"""Pairs that meet in buckets: blocks of large buckets, groups of sorted batches, and who owns a pair.

A pair may meet in several buckets. Its owner is the smallest bucket that both members share, so every pair is judged once and
counts can be added up. A bucket above the block size is cut into blocks, and each two blocks meet in a group of their own: work on
a hot bucket spreads over many tasks, each group has a bounded size, and what leaves a group is one row per member, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def sized(rows: DataFrame) -> DataFrame:
    """``(bucket, node, n)`` of the buckets that at least two nodes share."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "b")
    return rows.join(sizes, F.col("bucket") == F.col("b")).select("bucket", "node", "n")


def blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(group_id, side, bucket, node)``: every two members of a bucket meet in exactly one group.

    ``side`` is 0 where all pairs of the group count, else 1 and 2, and pairs of different sides count.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = members.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64("bucket", low, high).alias("group_id"), side.cast("int").alias("side"), "bucket", "node")


def memberships(members: DataFrame) -> DataFrame:
    """``(node, buckets)``: the sorted buckets of every node, at most as many as its runs or tables made."""
    return members.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of a group behind each other in one task."""
    return rows.repartition("group_id").sortWithinPartitions("group_id", "node")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a group ends."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table.column("group_id").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None:
        yield rest.combine_chunks()


def padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows of one matrix, filled with the largest long."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.asarray(flat.value_lengths())
    out = np.full((len(flat), max(1, int(counts.max(initial=0)))), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1])[None, :] < counts[:, None]] = flat.flatten().to_numpy()
    return out


def owned(buckets: np.ndarray, here: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Whether the bucket ``here`` of a pair is the smallest that its members share."""
    last = np.iinfo(np.int64).max
    out = np.ones(len(i), bool)
    for at in range(0, len(i), step):
        left, right = buckets[i[at : at + step]], buckets[j[at : at + step]]
        bound = here[i[at : at + step]]
        for k in range(left.shape[1]):
            col = left[:, k]
            early = np.flatnonzero((col < bound) & (col != last))
            if not len(early):
                break
            hit = (right[early] == col[early, None]).any(axis=1)
            out[at + early[hit]] = False
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.append(starts[1:], len(keys))


def roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For every member of a group, the smallest name that its links reach."""
    label = names.copy()
    i, j = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            return label
        label = new

"""Stratified folds that depend only on the data, never on partitioning or row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.labels import winner_class, winner_column_name
from pairwright.operators.rows import unpivot
from pairwright.schema import CLUSTER, FOLD, ID, N_FOLDS, WINNERS

#: Hex digits of the stratum bucket; 16 ** 3 rows at most meet in the one unpartitioned window below.
_STRATUM_DIGITS = 3


def stratum_by_cluster(cluster: str = CLUSTER, winners: Sequence[str] = WINNERS) -> Column:
    """Topic cluster and winning column, joined by an underscore."""
    return F.concat(F.coalesce(F.col(cluster).cast("string"), F.lit("nan")), F.lit("_"), winner_column_name(winners))


def stratum_by_target(winners: Sequence[str] = WINNERS) -> Column:
    return winner_class(winners).cast("string")


def assign_folds(
    df: DataFrame,
    stratum: Column,
    k: int = N_FOLDS,
    seed: int = 42,
    key: str = ID,
    fold: str = FOLD,
    keep_stratum: str | None = None,
    bucket_digits: int = 3,
) -> DataFrame:
    """Add a fold number in [0, k).

    All rows are put in the order (md5 of stratum, stratum, md5 of key and seed, key) and dealt out in
    turn, so fold sizes differ by at most one overall and within every stratum.

    The position is found without a global sort. Each stratum is cut into ``16 ** bucket_digits``
    buckets by the first digits of the row hash; a row needs its rank inside its bucket and the number of
    rows before that bucket. A stratum holding a third of the table is therefore ranked by thousands of
    groups, and the result is the same for every ``bucket_digits``. Counts before a bucket come
    from the table of bucket counts: a window per group of strata, plus one running sum over at most
    4,096 group totals.

    Rows without a key or stratum are dealt out like the others, so every row gets a fold. Rows that repeat a key may swap folds.

    Pass a narrow table: every column of ``df`` travels through one shuffle.
    """
    row_hash = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("nan")), F.lit(f":{seed}")))
    keyed = (
        df.withColumn("_stratum", F.coalesce(stratum, F.lit("nan")))
        .withColumn("_hash", row_hash)
        .withColumn("_bucket", F.substring("_hash", 1, bucket_digits))
    )
    offsets = _bucket_offsets(keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    in_bucket = Window.partitionBy("_stratum", "_bucket").orderBy("_hash", key)
    ranked = keyed.withColumn("_rank", F.row_number().over(in_bucket) - 1)
    position = F.col("_before") + F.col("_rank")
    out = ranked.join(offsets, ["_stratum", "_bucket"]).withColumn(fold, (position % k).cast("int"))
    if keep_stratum:
        out = out.withColumn(keep_stratum, F.col("_stratum"))
    return out.drop("_stratum", "_hash", "_bucket", "_rank", "_before")


def _bucket_offsets(counts: DataFrame) -> DataFrame:
    """(_stratum, _bucket, _before): rows that precede the bucket in the overall order."""
    counts = counts.withColumn("_order", F.md5("_stratum")).withColumn("_group", F.substring("_order", 1, _STRATUM_DIGITS))
    earlier = Window.partitionBy("_group").orderBy("_order", "_stratum", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Bounded by construction: _group has 16 ** 3 values whatever the table holds.
    earlier_groups = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_group_n"))
    groups = groups.select("_group", F.coalesce(F.sum("_group_n").over(earlier_groups), F.lit(0)).alias("_group_before"))
    within = counts.withColumn("_within", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return within.join(F.broadcast(groups), "_group").select(
        "_stratum", "_bucket", (F.col("_group_before") + F.col("_within")).alias("_before")
    )


def valid_rows(df: DataFrame, k: int, fold: str = FOLD) -> DataFrame:
    return df.filter(F.col(fold) == k)


def train_rows(df: DataFrame, k: int, fold: str = FOLD) -> DataFrame:
    return df.filter(F.col(fold) != k)


def fold_counts(df: DataFrame, fold: str = FOLD) -> DataFrame:
    """Rows per fold, largest first."""
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), fold)


def split_counts(df: DataFrame, k: int = N_FOLDS, fold: str = FOLD) -> DataFrame:
    """Training and validation rows of every split, from one pass over the table."""
    counts = [F.count_if(F.col(fold) == i).alias(f"_valid{i}") for i in range(k)]
    counts += [F.count_if(F.col(fold) != i).alias(f"_train{i}") for i in range(k)]
    rows = [{fold: F.lit(i), "n_train": F.col(f"_train{i}"), "n_valid": F.col(f"_valid{i}")} for i in range(k)]
    return unpivot(df.agg(*counts), [], rows)


def fold_balance(df: DataFrame, stratum: str, k: int = N_FOLDS, fold: str = FOLD) -> DataFrame:
    """Per stratum: rows, smallest and largest fold (empty folds count as 0) and their difference."""
    counts = [F.count_if(F.col(fold) == i).alias(f"_f{i}") for i in range(k)]
    sizes = [F.col(f"_f{i}") for i in range(k)]
    low, high = (F.least(*sizes), F.greatest(*sizes)) if k > 1 else (sizes[0], sizes[0])
    per_stratum = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *counts)
    return per_stratum.select(
        stratum, "n", low.alias("min_fold"), high.alias("max_fold"), (high - low).alias("spread")
    )

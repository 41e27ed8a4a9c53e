"""Alignment of tables by key. Position never decides which rows belong together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.schema import FOLD, ID, N_FOLDS, PREDS, TEACHER, WINNERS, rename_if_present, require
from pairwright.functions.labels import winner_class
from pairwright.operators.hot_keys import hot_join


def align_models(base: DataFrame, models: Mapping[str, DataFrame], key: str = ID, how: str = "inner", split_hot: bool = False, strict: bool = False) -> DataFrame:
    """Add ``<model>_a, <model>_b, <model>_tie`` for every model.

    All joins share the key, so Spark moves each table at most once: the result of one join is already
    distributed for the next. Where keys may repeat very often, ``split_hot`` finds those keys and splits them (:func:`hot_join`). ``strict`` raises
    unless every model has exactly the keys of ``base``, each once; else an inner join shrinks to the common keys.
    """
    out = base
    for name, preds in models.items():
        renamed = require(preds, [key, *PREDS], f"predictions of {name}").select(
            key, *[F.col(p).alias(f"{name}_{p.removeprefix('pred_')}") for p in PREDS]
        )
        if strict:
            require_aligned(base, renamed, key)
        out = hot_join(out, renamed, key, how) if split_hot else out.join(renamed, key, how)
    return out


def align_tables(tables: Sequence[DataFrame], key: str = ID) -> DataFrame:
    """Inner joins on the key, the safe form of putting tables side by side."""
    return reduce(lambda left, right: left.join(right, key), tables)


def backfill(df: DataFrame, labels: DataFrame, columns: Sequence[str], key: str = ID) -> DataFrame:
    """Left join of the columns that ``df`` lacks; nothing happens when it has them all."""
    absent = [c for c in columns if c not in df.columns]
    if not absent:
        return df
    return df.join(labels.select(key, *absent), key, "left")


def alignment_audit(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """One row: rows of both sides, matched keys, keys of one side only, repeated keys.

    The tagged union is counted per key, which combines repeated keys before the only shuffle; a full
    outer join would move both tables and multiply the repeats.
    """
    one, none = F.lit(1), F.lit(0)
    sides = left.select(key, one.alias("_l"), none.alias("_r")).unionByName(
        right.select(key, none.alias("_l"), one.alias("_r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    n_left, n_right = F.col("_l"), F.col("_r")
    return per_key.agg(
        F.coalesce(F.sum(n_left), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(n_right), F.lit(0)).alias("right_rows"),
        F.count_if((n_left > 0) & (n_right > 0)).alias("matched_keys"),
        F.count_if(n_right == 0).alias("left_only_keys"),
        F.count_if(n_left == 0).alias("right_only_keys"),
        F.count_if(n_left > 1).alias("left_repeated_keys"),
        F.count_if(n_right > 1).alias("right_repeated_keys"),
    )


def require_aligned(left: DataFrame, right: DataFrame, key: str = ID) -> None:
    """Raise unless both sides hold exactly the same keys, each once."""
    audit = alignment_audit(left, right, key).first()
    bad = {c: audit[c] for c in audit.asDict() if c.endswith(("only_keys", "repeated_keys")) and audit[c]}
    if bad:
        raise ValueError(f"tables do not align on {key}: {bad}")


def row_counts(sources: Mapping[str, DataFrame], expected: int | None = None) -> DataFrame:
    """Rows per source; with ``expected``, also whether the count is right."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
        for name, df in sources.items()
    ]
    out = reduce(DataFrame.unionByName, counts)
    return out if expected is None else out.withColumn("as_expected", F.col("n_rows") == expected)


def tagged_union(tables: Mapping[str, DataFrame], name: str = "run") -> DataFrame:
    """Stack tables, each marked with its name."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(tag)) for tag, df in tables.items()])


def union_folds(parts: Mapping[int, DataFrame], k: int = N_FOLDS, fold: str = FOLD) -> DataFrame:
    """Stack the outputs of all folds; refuse when any is missing."""
    absent = [i for i in range(k) if i not in parts]
    if absent:
        raise ValueError(f"no output for folds {absent}")
    return reduce(DataFrame.unionByName, [parts[i].withColumn(fold, F.lit(i)) for i in range(k)])


def oof_completeness(base: DataFrame, oof: DataFrame, k: int = N_FOLDS, key: str = ID, fold: str = FOLD) -> DataFrame:
    """Per fold: rows that need a prediction, rows that have exactly one, missing and repeated ones.

    Orphan predictions (no such row in ``base``) do not count; :func:`alignment_audit` reports them.
    """
    per_key = oof.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    counted = (
        base.select(key, fold)
        .join(per_key, key, "left")
        .filter(F.col(fold).between(0, k - 1))
        .groupBy(fold)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(n == 1).alias("n_scored"),
            F.count_if(n == 0).alias("n_missing"),
            F.count_if(n > 1).alias("n_repeated"),
        )
    )
    # counted has k rows at most, one per fold number
    every_fold = base.sparkSession.range(k).select(F.col("id").cast("int").alias(fold))
    filled = every_fold.join(F.broadcast(counted), fold, "left").fillna(0)
    return filled.withColumn("complete", (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_scored")))


def teacher_table(df: DataFrame, teacher: DataFrame | None = None, key: str = ID) -> DataFrame:
    """Rows with teacher probabilities, their array form and the class label."""
    if teacher is not None:
        df = df.join(rename_if_present(teacher, dict(zip(PREDS, TEACHER)), "teacher table").select(key, *TEACHER), key)
    df = rename_if_present(df, dict(zip(PREDS, TEACHER)), "teacher table")
    if "labels" not in df.columns:
        df = df.withColumn("labels", winner_class(WINNERS))
    return df.withColumn("teacher_probs", F.array(*TEACHER))


def select_like_model(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (ID,)) -> DataFrame:
    """The columns a saved model was trained on, in its order."""
    return require(df, features, "scoring table").select(*keep, *features)

"""Looking at rows: worst cases, conflicts, reproducible samples.

Rankings run on narrow tables, and texts are attached to the few rows that remain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import winner_label
from pairwright.functions.probs import EPS, one_hot_loss
from pairwright.functions.text import prefix
from pairwright.schema import CLUSTER, ID, PREDS, WINNERS


def bad_cases(
    df: DataFrame,
    n: int = 50,
    probs: Sequence[str] = PREDS,
    winners: Sequence[str] = WINNERS,
    keep: Sequence[str] = (ID, CLUSTER),
    key: str = ID,
    eps: float = EPS,
    digits: int = 6,
) -> DataFrame:
    """The ``n`` rows with the highest loss, of those that have one. Losses are compared after rounding and ties go to the lower key."""
    loss = F.round(one_hot_loss(probs, winners, eps), digits)
    columns = list(dict.fromkeys([*keep, *winners, *probs]))
    scored = df.select(*columns, loss.alias("sample_loss"))
    return scored.filter(F.col("sample_loss").isNotNull()).orderBy(F.desc("sample_loss"), key).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def attach_text(rows: DataFrame, texts: DataFrame, key: str = ID) -> DataFrame:
    """Join texts onto a few rows. Spark's own size check chooses how: rows cut by a limit have a small, known size."""
    return texts.join(rows, key)


def case_cards(
    df: DataFrame, probs: Sequence[str] = PREDS, winners: Sequence[str] = WINNERS, cluster: str = CLUSTER, prompt: str = "prompt_text"
) -> DataFrame:
    """Display fields of worst cases: loss, cluster, start of the prompt, winner, probabilities."""
    return df.select(
        ID,
        F.round("sample_loss", 4).alias("sample_loss"),
        cluster,
        prefix(prompt, 200, "...").alias("prompt_head"),
        winner_label(winners).alias("winner"),
        *[F.round(p, 2).alias(f"show_{s}") for p, s in zip(probs, ("a", "b", "tie"))],
    )


def conflicts(df: DataFrame, min_len_diff: float = 500, a: str = "pred_a", b: str = "pred_b", len_diff: str = "len_diff") -> DataFrame:
    """Rows where A is much longer and the model still prefers B."""
    return df.filter((F.col(len_diff) > min_len_diff) & (F.col(b) > F.col(a)))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = ID) -> DataFrame:
    """Exactly ``n`` rows (or all, when there are fewer), the same ones on every run and partitioning."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")


def has_at_least(df: DataFrame, n: int) -> bool:
    """Whether the table has ``n`` rows; reads no further than it must."""
    return df.limit(n).count() >= n


def sample_or_none(df: DataFrame, n: int, seed: int = 42, key: str = ID) -> DataFrame | None:
    """A sample, or ``None`` when there are fewer than ``n`` rows to draw from."""
    return sample_rows(df, n, seed, key) if has_at_least(df, n) else None


def head_rows(df: DataFrame, columns: Sequence[str], n: int = 3, key: str = ID) -> DataFrame:
    return df.orderBy(key).limit(n).select(*columns)


def in_output_order(df: DataFrame, *columns: str) -> DataFrame:
    """Sort a final result, by key (source order) unless columns are given."""
    return df.orderBy(*(columns or (ID,)))


def sample_cards(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Prompt, both responses and the winner's name, for display."""
    label: Column = winner_label(names=("Model A", "Model B", "Tie"))
    columns = names or {"prompt_text": "prompt", "res_a_text": "response_a", "res_b_text": "response_b"}
    return df.select(ID, *[F.col(c).alias(alias) for c, alias in columns.items()], label.alias("winner"))

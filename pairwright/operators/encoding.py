"""Categories as numbers: class frequencies of a category in the other folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import winner_class
from pairwright.schema import CLASSES, FOLD, WINNERS, require

SUFFIXES = ("a", "b", "tie")


def fold_encoding(df: DataFrame, categories: Sequence[str], fold: str = FOLD, winners: Sequence[str] = WINNERS, smoothing: float = 10.0, drop: bool = True) -> DataFrame:
    """Columns ``<category>__a``, ``__b`` and ``__tie``: how often each class has that category in all folds but the row's own.

    Frequencies are shrunk to those of all rows of the other folds, which count as ``smoothing`` rows: a category seen nowhere else gets
    exactly these. A missing category is a value of its own. Rows without a label count nowhere and are encoded like all others; rows of no fold
    leave nothing out. Any number of values is allowed: counts are combined before their shuffle, and a category on very many rows is a row
    per fold there. With ``drop`` the category itself goes.
    """
    require(df, [*categories, fold, *winners], "table to encode")
    label = winner_class(winners)
    hits = [F.count_if(label == c).alias(f"_n{c}") for c in CLASSES]
    by_fold = df.groupBy(F.col(fold).alias("_f")).agg(*hits)
    whole = by_fold.agg(*[F.coalesce(F.sum(f"_n{c}"), F.lit(0)).alias(f"_w{c}") for c in CLASSES])
    own = by_fold.select("_f", *[F.col(f"_n{c}").alias(f"_o{c}") for c in CLASSES])
    totals = {r["_f"]: [r[f"_o{c}"] for c in CLASSES] for r in own.where("_f IS NOT NULL").collect()}  # a row per fold
    all_rows = list(whole.first())
    out = df
    for i, category in enumerate(categories):
        value = F.col(f"`{category}`").cast("string")
        counts = df.groupBy(value.alias("_v"), F.col(fold).alias("_f")).agg(*hits)
        every = counts.groupBy("_v").agg(*[F.sum(f"_n{c}").alias(f"_s{c}") for c in CLASSES]).withColumnRenamed("_v", "_u")
        left = counts.join(every, F.col("_v").eqNullSafe(F.col("_u")))
        rest = [F.when(F.col("_f").isNull(), F.col(f"_s{c}")).otherwise(F.col(f"_s{c}") - F.col(f"_n{c}")) for c in CLASSES]
        prior = [_prior(c, totals, all_rows) for c in CLASSES]
        n = rest[0] + rest[1] + rest[2]
        names = [f"{category}__{s}" for s in SUFFIXES]
        table = left.select("_v", F.col("_f").alias("_g"), *[((r + smoothing * p) / (n + smoothing)).alias(x) for r, p, x in zip(rest, prior, names)])
        table = table.withColumnsRenamed({"_v": f"_v{i}", "_g": f"_g{i}"})
        out = out.join(table, value.eqNullSafe(F.col(f"_v{i}")) & F.col(f"`{fold}`").eqNullSafe(F.col(f"_g{i}")), "left").drop(f"_v{i}", f"_g{i}")
    return out.drop(*categories) if drop else out


def _prior(cls: int, by_fold: dict, whole: Sequence[int]):
    """The share of a class among the labelled rows outside the fold ``_f``."""
    share = lambda n: float(n[cls]) / sum(n) if sum(n) else 1.0 / len(CLASSES)
    column = F.lit(share(whole))
    for f, n in by_fold.items():
        column = F.when(F.col("_f") == f, F.lit(share([w - x for w, x in zip(whole, n)]))).otherwise(column)
    return column

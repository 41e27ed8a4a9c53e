"""Column names, table schemas and the guards that check them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ID = "id"
FOLD = "fold"
CLUSTER = "cluster_id_k20"
TEXTS = ("prompt_text", "res_a_text", "res_b_text")
WINNERS = ("winner_model_a", "winner_model_b", "winner_tie")
PREDS = ("pred_a", "pred_b", "pred_tie")
TEACHER = ("teacher_a", "teacher_b", "teacher_tie")
CLASSES = (0, 1, 2)
N_FOLDS = 5

#: Never model inputs: keys, outcomes, fold numbers and texts.
NOT_FEATURES = (ID, FOLD, "target", *WINNERS, *TEXTS)

PAIR_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType())]
    + [T.StructField(c, T.StringType()) for c in TEXTS]
    + [T.StructField(CLUSTER, T.IntegerType())]
    + [T.StructField(c, T.IntegerType()) for c in WINNERS]
)
OOF_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in PREDS] + [T.StructField(ID, T.LongType())])
PREFERENCE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("prompt", "chosen", "rejected")])
LOG_RECORD_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in ("loss", "eval_loss", "epoch")])
RUN_STATE_SCHEMA = T.StructType([T.StructField("best_model_checkpoint", T.StringType())])


class SchemaError(ValueError):
    """A table lacks columns an operator needs."""


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise when any of ``columns`` is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def rename_if_present(df: DataFrame, mapping: Mapping[str, str], what: str = "table") -> DataFrame:
    """Rename every column of ``mapping``; accept a table that already has the new names."""
    if all(c in df.columns for c in mapping):
        return df.withColumnsRenamed(dict(mapping))
    return require(df, list(mapping.values()), what)


# ---------------------------------------------------------------- column selection


def columns_like(df: DataFrame, *, prefix: str | None = None, contains: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Names that start with ``prefix`` or contain any of ``contains``, in table order."""
    return [
        c
        for c in df.columns
        if c not in exclude and ((prefix is not None and c.startswith(prefix)) or any(part in c for part in contains))
    ]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def fractional_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exclude
    ]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_columns(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    """Everything that is not excluded, in table order."""
    return [c for c in df.columns if c not in exclude]


def categorical_columns(features: Sequence[str]) -> list[str]:
    """Topic clusters and task flags are categories whatever their storage type."""
    return [c for c in features if "cluster" in c or "is_code" in c]


def feature_set(df: DataFrame, models: Sequence[str] = (), manual: bool = True) -> list[str]:
    """Manual features and/or the three probabilities of each named model; an empty choice is an error."""
    model_cols = [f"{m}_{s}" for m in models for s in ("a", "b", "tie")]
    require(df, model_cols, "feature table")
    others = {c for c in df.columns if c.rsplit("_", 1)[-1] in ("a", "b", "tie") and _is_model_column(df, c)}
    chosen = [c for c in feature_columns(df) if c not in others and c not in model_cols] if manual else []
    chosen += model_cols
    if not chosen:
        raise SchemaError("no features selected")
    return chosen


def _is_model_column(df: DataFrame, column: str) -> bool:
    stem = column.rsplit("_", 1)[0]
    return all(f"{stem}_{s}" in df.columns for s in ("a", "b", "tie"))

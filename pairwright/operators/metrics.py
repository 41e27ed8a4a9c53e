"""Evaluation of three-class predictions.

Every function takes ``models``: a mapping from a model's name to its three probability columns. All models
are measured in the same pass: the aggregates are columns of one ``agg``, and only its few result
rows are turned into one row per model. Nothing is multiplied before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.labels import prob_class, winner_class
from pairwright.functions.probs import EPS, all_numbers, class_loss, one_hot_loss, pick, softmax
from pairwright.operators.rows import unpivot
from pairwright.schema import CLASSES, CLUSTER, FOLD, ID, N_FOLDS, WINNERS

Models = Mapping[str, Sequence[str]]
_Y = "_y"


def with_class(df: DataFrame, winners: Sequence[str] = WINNERS, name: str = "y") -> DataFrame:
    return df.withColumn(name, winner_class(winners))


def class_table(df: DataFrame, models: Models, keep: Sequence[str] = (ID,), winners: Sequence[str] = WINNERS) -> DataFrame:
    """True class and each model's predicted class per row."""
    return df.select(
        *keep, winner_class(winners).alias("y"), *[prob_class(p).alias(f"{m}_class") for m, p in models.items()]
    )


def sample_loss(
    df: DataFrame, models: Models, keep: Sequence[str] = (ID,), winners: Sequence[str] = WINNERS, eps: float = EPS
) -> DataFrame:
    """Cross-entropy of every row under each model, as ``<model>_loss``."""
    return df.select(*keep, *[one_hot_loss(p, winners, eps).alias(f"{m}_loss") for m, p in models.items()])


def _measures(models: Models, eps: float) -> list[Column]:
    out = []
    for m, probs in models.items():
        loss = class_loss(_Y, probs, eps)
        hit = F.when(loss.isNotNull(), (prob_class(probs) == F.col(_Y)).cast("double"))
        out += [F.count(loss).alias(f"{m}|n"), F.avg(loss).alias(f"{m}|loss"), F.avg(hit).alias(f"{m}|hit")]
    return out


def _model_rows(models: Models) -> list[dict[str, Column]]:
    return [
        {
            "model": F.lit(m),
            "n": F.col(f"`{m}|n`"),
            "log_loss": F.col(f"`{m}|loss`"),
            "accuracy": F.col(f"`{m}|hit`"),
        }
        for m in models
    ]


def model_metrics(
    df: DataFrame,
    models: Models,
    by: Sequence[str] = (),
    winners: Sequence[str] = WINNERS,
    eps: float = EPS,
) -> DataFrame:
    """(by.., model, n, log_loss, accuracy).

    All three are taken over the same rows: those with a known class and three finite probabilities.
    """
    narrow = df.select(*by, winner_class(winners).alias(_Y), *_columns(models))
    grouped = narrow.groupBy(*by).agg(*_measures(models, eps))
    return unpivot(grouped, by, _model_rows(models))


def fold_metrics(
    df: DataFrame, models: Models, k: int = N_FOLDS, fold: str = FOLD, winners: Sequence[str] = WINNERS, eps: float = EPS
) -> DataFrame:
    """One row per fold and model. A fold without rows is reported with n = 0 and no loss; rows of another fold, or of none,
    are reported under that number, or NULL.
    """
    measured = model_metrics(df, models, [fold], winners, eps)
    folds = df.sparkSession.range(k).select(F.col("id").cast("int").alias(fold))
    every = folds.select(fold, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    joined = every.join(measured, [fold, "model"], "full")
    return joined.withColumn("n", F.coalesce(F.col("n"), F.lit(0)))


def mean_of_folds(metrics_by_fold: DataFrame, fold: str = FOLD) -> DataFrame:
    """Unweighted mean of the fold scores per model, the objective of a parameter search. Rows without a fold do not count."""
    return metrics_by_fold.filter((F.col("n") > 0) & F.col(fold).isNotNull()).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("log_loss").alias("mean_log_loss"), F.avg("accuracy").alias("mean_accuracy")
    )


def cluster_loss(
    df: DataFrame, models: Models, cluster: str = CLUSTER, winners: Sequence[str] = WINNERS, eps: float = EPS
) -> DataFrame:
    """Mean row loss per cluster and model, with the overall mean as a reference line.

    The overall means come from one scalar subquery over the per-cluster sums, shared by all models; no row is
    joined to it.
    """
    losses = {m: one_hot_loss(p, winners, eps) for m, p in models.items()}
    sums = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(loss).alias(f"_{m}_sum") for m, loss in losses.items()],
        *[F.count(loss).alias(f"_{m}_n") for m, loss in losses.items()],
    )
    totals = [(F.sum(f"_{m}_sum") / F.sum(f"_{m}_n")).alias(m) for m in models]
    total = sums.agg(F.struct(*totals)).scalar()
    overall = [total[m].alias(f"{m}_overall") for m in models]
    means = [(F.col(f"_{m}_sum") / F.col(f"_{m}_n")).alias(f"{m}_loss") for m in models]
    return sums.select(cluster, "n", *means, *overall)


def confusion_matrix(df: DataFrame, models: Models, winners: Sequence[str] = WINNERS) -> DataFrame:
    """All nine cells per model: count and share of the true class (0 when that class is absent)."""
    cells = _confusion_cells(df, models, winners)
    rows = []
    for m in models:
        for t in CLASSES:
            total = sum((F.col(_cell(m, t, p)) for p in CLASSES[1:]), F.col(_cell(m, t, 0)))
            for p in CLASSES:
                share = F.when(total > 0, F.col(_cell(m, t, p)) / total).otherwise(F.lit(0.0))
                rows.append(
                    {
                        "model": F.lit(m),
                        "true_class": F.lit(t),
                        "pred_class": F.lit(p),
                        "n": F.col(_cell(m, t, p)),
                        "share": share,
                    }
                )
    return unpivot(cells, [], rows)


def class_report(df: DataFrame, models: Models, winners: Sequence[str] = WINNERS) -> DataFrame:
    """Precision, recall, F1 and support per model and class; 0 where a ratio is undefined."""
    cells = _confusion_cells(df, models, winners)
    rows = []
    for m in models:
        for k in CLASSES:
            hit = F.col(_cell(m, k, k))
            predicted = sum((F.col(_cell(m, t, k)) for t in CLASSES[1:]), F.col(_cell(m, 0, k)))
            actual = sum((F.col(_cell(m, k, p)) for p in CLASSES[1:]), F.col(_cell(m, k, 0)))
            rows.append(
                {
                    "model": F.lit(m),
                    "class": F.lit(k),
                    "precision": _ratio(hit, predicted),
                    "recall": _ratio(hit, actual),
                    "f1": _ratio(2 * hit, predicted + actual),
                    "support": actual,
                }
            )
    return unpivot(cells, [], rows)


def _cell(model: str, true: int, pred: int) -> str:
    return f"{model}_{true}_{pred}"


def _confusion_cells(df: DataFrame, models: Models, winners: Sequence[str]) -> DataFrame:
    """One row holding every cell of every model."""
    narrow = df.select(winner_class(winners).alias(_Y), *[prob_class(p).alias(m) for m, p in models.items()])
    return narrow.agg(
        *[
            F.count_if((F.col(_Y) == t) & (F.col(m) == p)).alias(_cell(m, t, p))
            for m in models
            for t in CLASSES
            for p in CLASSES
        ]
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def softmax_probs(df: DataFrame, logits: Sequence[str], out: Sequence[str] = ("pred_a", "pred_b", "pred_tie")) -> DataFrame:
    return df.withColumns(dict(zip(out, softmax(logits))))


def logit_metrics(df: DataFrame, logits: Models, winners: Sequence[str] = WINNERS, eps: float = EPS) -> DataFrame:
    """Log loss and accuracy straight from logits.

    The loss of a row is the logarithm of the sum of exponentials minus the true class's logit, so only the row maximum, three
    exponentials and one logarithm are needed; each is a column of its own step and evaluated once. Losses are held inside the
    range that clipped probabilities give.
    """
    narrow = df.select(winner_class(winners).alias(_Y), *_columns(logits))
    for m, cols in logits.items():
        narrow = narrow.withColumn(f"{m}|top", F.when(all_numbers(cols), F.greatest(*cols)))
    low, high = -math.log(1.0 - eps), -math.log(eps)
    for m, cols in logits.items():
        total = reduce(lambda a, b: a + b, [F.exp(F.col(c) - F.col(f"`{m}|top`")) for c in cols])
        loss = F.ln(total) + F.col(f"`{m}|top`") - pick(_Y, cols)
        narrow = narrow.withColumn(f"{m}|one", F.when(loss.isNotNull(), F.least(F.greatest(loss, F.lit(low)), F.lit(high))))
        narrow = narrow.withColumn(f"{m}|ok", F.when(loss.isNotNull(), (prob_class(cols) == F.col(_Y)).cast("double")))
    measures = []
    for m in logits:
        one, ok = F.col(f"`{m}|one`"), F.col(f"`{m}|ok`")
        measures += [F.count(one).alias(f"{m}|n"), F.avg(one).alias(f"{m}|loss"), F.avg(ok).alias(f"{m}|hit")]
    return unpivot(narrow.agg(*measures), [], _model_rows(logits))


def fold_softmax_weights(
    metrics_by_fold: DataFrame, temperature: float = 0.05, empty_score: float = 10.0, fold: str = FOLD
) -> DataFrame:
    """Weight of each fold's model from its loss, relative to the best fold.

    The input has one row per fold and model, so the windows hold k rows each.
    """
    of_model = Window.partitionBy("model")
    metrics_by_fold = metrics_by_fold.filter(F.col(fold).isNotNull())  # rows without a fold have no model
    score = F.when(F.col("n") > 0, F.col("log_loss")).otherwise(F.lit(float(empty_score)))
    scored = metrics_by_fold.withColumn("score", score)
    raw = scored.withColumn("_e", F.exp((F.min("score").over(of_model) - F.col("score")) / F.lit(float(temperature))))
    return raw.withColumn("weight", F.col("_e") / F.sum("_e").over(of_model)).drop("_e")


def _columns(models: Models) -> list[str]:
    return list(dict.fromkeys(c for probs in models.values() for c in probs))

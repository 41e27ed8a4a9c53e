"""Blends of several models and the weights that make the blend best."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import winner_class
from pairwright.functions.probs import EPS, all_numbers, blend, normalise, pick
from pairwright.operators.metrics import Models, model_metrics
from pairwright.schema import WINNERS


def blend_columns(df: DataFrame, models: Models, weights: Mapping[str, float], name: str = "blend") -> DataFrame:
    """Add ``<name>_a, <name>_b, <name>_tie``."""
    mixed = blend([models[m] for m in weights], list(weights.values()))
    return df.withColumns({f"{name}_{s}": c for s, c in zip(("a", "b", "tie"), mixed)})


def blend_metrics(
    df: DataFrame, models: Models, weights: Mapping[str, float], name: str = "blend", winners: Sequence[str] = WINNERS
) -> DataFrame:
    """Scores of every single model and of the blend, in one pass."""
    everyone = {**models, name: [f"{name}_{s}" for s in ("a", "b", "tie")]}
    return model_metrics(blend_columns(df, models, weights, name), everyone, winners=winners)


def true_class_probs(df: DataFrame, models: Models, winners: Sequence[str] = WINNERS) -> DataFrame:
    """One column per model: the probability it gave to the true class, all a blend's log loss depends on.

    It is NULL where the class is unknown or some probability of the model is no finite number; a blend of such a row is NULL too,
    so the row drops out of every average.
    """
    y = df.select(winner_class(winners).alias("_y"), *[c for p in models.values() for c in p])
    return y.select(*[F.when(all_numbers(p), pick("_y", p).cast("double")).alias(m) for m, p in models.items()])


def simplex_grid(k: int, steps: int) -> list[tuple[float, ...]]:
    """Every way to split 1 into ``k`` multiples of ``1 / steps``."""
    out = []
    for bars in combinations(range(steps + k - 1), k - 1):
        edges = (-1, *bars, steps + k - 1)
        out.append(tuple((edges[i + 1] - edges[i] - 1) / steps for i in range(k)))
    return out


def ensemble_grid(
    df: DataFrame, models: Models, steps: int = 20, winners: Sequence[str] = WINNERS, eps: float = EPS
) -> DataFrame:
    """(w_<model>.., log_loss) for every point of the weight grid; NULL where no row is usable.

    No row is multiplied: a batch of rows meets all points in one matrix product and leaves one sum per point, and these sums are
    added up by point. The grid's size depends only on ``steps`` and the number of models.
    """
    names = list(models)
    points = simplex_grid(len(names), steps)
    weights = np.array(points)

    def sums(batches):
        for batch in batches:
            q = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            q = q[:, ~np.isnan(q).any(axis=0)]  # NULL arrives as NaN
            total = np.zeros(len(weights))
            for at in range(0, q.shape[1], 1024):
                total -= np.log(np.clip(weights @ q[:, at : at + 1024], eps, 1.0 - eps)).sum(axis=1)
            counts = np.full(len(weights), q.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights), dtype=np.int32)), pa.array(total), pa.array(counts)], names=["point", "loss", "n"])

    probs = true_class_probs(df, models, winners).mapInArrow(sums, "point int, loss double, n long")
    means = probs.groupBy("point").agg((F.sum("loss") / F.nullif(F.sum("n"), F.lit(0))).alias("log_loss"))
    grid = df.sparkSession.createDataFrame([(i, *map(float, w)) for i, w in enumerate(points)], "point int, " + ", ".join(f"`w_{m}` double" for m in names))
    return grid.join(means, "point", "left").select(*[f"w_{m}" for m in names], "log_loss")


@dataclass(frozen=True)
class BlendFit:
    """Best weights, their loss, an upper bound on how far that is from the optimum, the passes used, and whether the
    bound reached the tolerance (or 1e-8, below which sums of many rows cannot tell).
    """

    weights: dict[str, float]
    log_loss: float
    gap: float
    passes: int
    converged: bool


def fit_blend(
    df: DataFrame,
    models: Models,
    winners: Sequence[str] = WINNERS,
    eps: float = EPS,
    tolerance: float = 1e-10,
    max_passes: int = 50,
) -> BlendFit:
    """Weights on the simplex with the lowest log loss of the blend.

    Newton's method on a convex function. One aggregation returns loss, gradient and Hessian (1 + k + k(k+1)/2
    numbers); the driver solves the k-variable quadratic model and halves the step while the true loss
    does not fall. It stops when the bound ``w.g - min g`` on the remaining improvement is below
    ``tolerance``.
    """
    names = list(models)
    probs = true_class_probs(df, models, winners).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w = np.full(len(names), 1.0 / len(names))
        loss, g, h = _derivatives(probs, names, w, eps)
        passes = 1
        while passes < max_passes and w @ g - g.min() > tolerance:
            target, t = _quadratic_step(w, g, h), 1.0
            accepted = False
            while passes < max_passes and t > 1e-6:
                trial = w + t * (target - w)
                trial_loss, trial_g, trial_h = _derivatives(probs, names, trial, eps)
                passes += 1
                if trial_loss <= loss + 1e-15:
                    accepted = True
                    break
                t /= 2
            if not accepted:
                break
            w, loss, g, h = trial, trial_loss, trial_g, trial_h
    finally:
        probs.unpersist()
    w = normalise(np.maximum(w, 0.0).tolist())
    gap = float(np.dot(w, g) - g.min())
    return BlendFit(dict(zip(names, w)), float(loss), gap, passes, gap <= max(tolerance, 1e-8))


def ensemble_weights(df: DataFrame, models: Models, winners: Sequence[str] = WINNERS) -> DataFrame:
    """(model, weight, log_loss): one row per model, with the loss of the best blend. An unfinished fit is an error."""
    fit = fit_blend(df, models, winners)
    if not fit.converged:
        raise RuntimeError(f"no optimum within {fit.passes} passes; the loss may be {fit.gap} above it")
    rows = [(m, float(w), fit.log_loss) for m, w in fit.weights.items()]
    return df.sparkSession.createDataFrame(rows, "model string, weight double, log_loss double")


def _derivatives(probs: DataFrame, names: Sequence[str], w: np.ndarray, eps: float) -> tuple[float, np.ndarray, np.ndarray]:
    k = len(names)
    blended = _sum([F.lit(float(wi)) * F.col(m) for wi, m in zip(w, names)])
    mixed = F.when(blended.isNotNull(), F.greatest(blended, F.lit(eps)))  # greatest alone would skip a NULL
    row = probs.select(*names, mixed.alias("_s"))
    ratio = [F.col(m) / F.col("_s") for m in names]
    aggs = [F.avg(F.lit(0.0) - F.ln("_s"))]
    aggs += [F.avg(-r) for r in ratio]
    aggs += [F.avg(ratio[i] * ratio[j]) for i in range(k) for j in range(i, k)]
    values = list(row.agg(*[a.alias(f"v{i}") for i, a in enumerate(aggs)]).first())
    if values[0] is None:
        raise ValueError("no usable rows")
    h = np.zeros((k, k))
    h[np.triu_indices(k)] = values[1 + k :]
    h = h + np.triu(h, 1).T
    return float(values[0]), np.array(values[1 : 1 + k]), h


def _quadratic_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """Minimise g.d + d.H.d / 2 over the simplex by moving weight between the worst pair.

    Needs no inverse, so two identical models (a singular Hessian) are no special case.
    """
    x = w.copy()
    for _ in range(20_000):
        slope = g + h @ (x - w)
        gain = int(np.argmin(slope))
        lose = int(np.argmax(np.where(x > 0, slope, -math.inf)))
        difference = slope[lose] - slope[gain]
        if difference <= tolerance:
            break
        curvature = h[gain, gain] + h[lose, lose] - 2 * h[gain, lose]
        step = x[lose] if curvature <= 1e-300 else min(x[lose], difference / curvature)
        x[gain] += step
        x[lose] -= step
    return x


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out

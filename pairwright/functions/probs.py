"""Probabilities: clipping, losses, softmax, blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.labels import ColumnOrName, as_col
from pairwright.schema import WINNERS

EPS = 1e-15


def clip(p: ColumnOrName, eps: float = EPS) -> Column:
    """``p`` held inside [eps, 1 - eps].

    NULL and NaN stay without a value: ``greatest`` skips NULL, and Spark orders NaN above every number,
    so a plain ``least(greatest(..))`` would turn them into eps and 1 - eps.
    """
    p = as_col(p)
    return F.when(is_number(p), F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))


def is_number(p: ColumnOrName) -> Column:
    """Whether a value is present and finite; never NULL itself. Spark orders NaN above infinity, so one comparison tells."""
    return F.coalesce(F.abs(as_col(p).cast("double")) < F.lit(float("inf")), F.lit(False))


def all_numbers(values: Sequence[ColumnOrName]) -> Column:
    """Whether all values are present and finite: otherwise their sum is not."""
    return is_number(_total([as_col(v).cast("double") for v in values]))


def one_hot_loss(probs: Sequence[ColumnOrName], winners: Sequence[ColumnOrName] = WINNERS, eps: float = EPS) -> Column:
    """Cross-entropy of one row against its one-hot winners; NULL when a winner or a probability is missing."""
    terms = [as_col(w) * F.ln(clip(p, eps)) for w, p in zip(winners, probs)]
    return F.lit(0.0) - (terms[0] + terms[1] + terms[2])


def pick(y: ColumnOrName, values: Sequence[ColumnOrName]) -> Column:
    """The value that belongs to class ``y``; NULL when the class is unknown."""
    y, (a, b, t) = as_col(y), [as_col(v) for v in values]
    return F.when(y == 0, a).when(y == 1, b).when(y == 2, t)


def class_loss(y: ColumnOrName, probs: Sequence[ColumnOrName], eps: float = EPS) -> Column:
    """Cross-entropy of one row against its class number.

    A row is usable when its class is known and all its probabilities are finite numbers; any other row has no loss.
    """
    return F.when(all_numbers(probs), F.lit(0.0) - F.ln(clip(pick(y, probs), eps)))


def softmax(logits: Sequence[ColumnOrName], temperature: float = 1.0) -> list[Column]:
    """Softmax over the given columns, shifted by the row maximum so that exp never overflows."""
    exps = _shifted_exps(logits, temperature)
    total = _total(exps)
    return [e / total for e in exps]


def log_softmax(logits: Sequence[ColumnOrName], temperature: float = 1.0) -> list[Column]:
    scaled = [as_col(c) / F.lit(float(temperature)) for c in logits]
    peak = F.greatest(*scaled)
    norm = F.ln(_total([F.exp(c - peak) for c in scaled]))
    return [c - peak - norm for c in scaled]


def _shifted_exps(logits: Sequence[ColumnOrName], temperature: float) -> list[Column]:
    scaled = [as_col(c) / F.lit(float(temperature)) for c in logits]
    peak = F.greatest(*scaled)
    return [F.exp(c - peak) for c in scaled]


def blend(models: Sequence[Sequence[ColumnOrName]], weights: Sequence[float]) -> list[Column]:
    """Weighted average of several models' probability triples; weights are scaled to sum to 1."""
    weights = normalise(weights)
    return [_total([as_col(m[i]) * F.lit(w) for m, w in zip(models, weights)]) for i in range(3)]


def normalise(weights: Sequence[float]) -> list[float]:
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return [float(w) / total for w in weights]


def _total(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out

"""Outcomes: one-hot winners, class numbers and display names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.schema import WINNERS

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_maximum(cols: Sequence[Column], labels: Sequence) -> Column:
    a, b, t = cols
    return F.when((a >= b) & (a >= t), labels[0]).when(b >= t, labels[1]).otherwise(labels[2])


def winner_class(winners: Sequence[ColumnOrName] = WINNERS) -> Column:
    """0, 1 or 2 from one-hot winners.

    The first maximum wins, so an all-zero row is class 0. A row without any winner value (an
    unlabelled row after a left join) has no class.
    """
    raw = [as_col(c) for c in winners]
    filled = [F.coalesce(c, F.lit(0)) for c in raw]
    return F.when(F.coalesce(*raw).isNotNull(), _first_maximum(filled, (0, 1, 2))).cast("int")


def winner_column_name(winners: Sequence[str] = WINNERS) -> Column:
    """The name of the winning column, used in stratum keys."""
    filled = [F.coalesce(F.col(c), F.lit(0)) for c in winners]
    return _first_maximum(filled, tuple(winners))


def prob_class(probs: Sequence[ColumnOrName]) -> Column:
    """Arg-max class of three probabilities; the first maximum wins. A missing value or a NaN among them leaves no class."""
    a, b, t = (as_col(c).cast("double") for c in probs)
    known = F.coalesce(F.abs(a + b + t) < F.lit(float("inf")), F.lit(False))
    return F.when(known, _first_maximum((a, b, t), (0, 1, 2))).cast("int")


def winner_label(winners: Sequence[ColumnOrName] = WINNERS, names: Sequence[str] = ("A", "B", "Tie")) -> Column:
    """Display name of the outcome; anything that is neither A nor B is shown as a tie."""
    a, b = as_col(winners[0]), as_col(winners[1])
    return F.when(a == 1, names[0]).when(b == 1, names[1]).otherwise(names[2])


def winners_valid(winners: Sequence[ColumnOrName] = WINNERS) -> Column:
    """True when exactly one winner flag is set."""
    total = sum((F.coalesce(as_col(c), F.lit(0)) for c in winners), F.lit(0))
    return total == 1

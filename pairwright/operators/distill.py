"""Teacher-student loss of a distilled model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import as_col, winner_class
from pairwright.functions.probs import EPS, is_number, log_softmax, pick, softmax
from pairwright.schema import TEACHER, WINNERS

MODES = ("as_is", "renormalised")


def teacher_target(teacher: Sequence[str], temperature: float, mode: str = "as_is") -> list[Column]:
    """Softened teacher distribution.

    ``as_is`` applies the softmax to the given values although they are probabilities already;
    ``renormalised`` raises them to 1 / T and scales them to sum to 1.
    """
    if mode == "as_is":
        return softmax([F.when(is_number(t), as_col(t)) for t in teacher], temperature)
    if mode != "renormalised":
        raise ValueError(f"mode is one of {MODES}")
    powered = [F.pow(F.when(is_number(t), F.greatest(as_col(t), F.lit(EPS))), F.lit(1.0 / temperature)) for t in teacher]
    total = powered[0] + powered[1] + powered[2]
    return [p / total for p in powered]


def kl_divergence(target: Sequence[Column], log_q: Sequence[Column]) -> Column:
    """NULL when the target or the other distribution has no number."""
    terms = [F.when(is_number(t) & is_number(q), F.when(t > 0, t * (F.ln(t) - q)).otherwise(F.lit(0.0))) for t, q in zip(target, log_q)]
    return terms[0] + terms[1] + terms[2]


def distill_rows(
    df: DataFrame,
    logits: Sequence[str],
    teacher: Sequence[str] = TEACHER,
    winners: Sequence[str] = WINNERS,
    temperature: float = 2.0,
    alpha: float = 0.5,
    mode: str = "as_is",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Hard, soft and mixed loss of every row."""
    hard = F.lit(0.0) - pick(winner_class(winners), log_softmax(logits))
    soft = kl_divergence(teacher_target(teacher, temperature, mode), log_softmax(logits, temperature))
    rows = df.select(*keep, hard.alias("hard_loss"), (soft * F.lit(temperature * temperature)).alias("soft_loss"))
    mixed = F.lit(alpha) * F.col("hard_loss") + F.lit(1.0 - alpha) * F.col("soft_loss")
    return rows.withColumn("loss", mixed)


def distill_loss(df: DataFrame, logits: Sequence[str], modes: Sequence[str] = MODES, **options) -> DataFrame:
    """(mode, n, hard_loss, soft_loss, loss): means over the n rows that have a class, logits and a teacher, every mode in one pass."""
    keep = list(dict.fromkeys([*logits, *options.get("teacher", TEACHER), *options.get("winners", WINNERS)]))
    out = df.select(*keep)
    for mode in modes:
        rows = distill_rows(out, logits, mode=mode, keep=out.columns, **options)
        out = rows.withColumnsRenamed({c: f"{mode}|{c}" for c in ("hard_loss", "soft_loss", "loss")})
    parts = ("hard_loss", "soft_loss", "loss")
    means = out.agg(
        *[F.count(f"{m}|loss").alias(f"{m}|n") for m in modes], *[F.avg(F.when(F.col(f"`{m}|loss`").isNotNull(), F.col(f"`{m}|{c}`"))).alias(f"{m}|{c}") for m in modes for c in parts]
    )
    structs = [
        F.struct(F.lit(m).alias("mode"), F.col(f"{m}|n").alias("n"), *[F.col(f"{m}|{c}").alias(c) for c in parts]) for m in modes
    ]
    return means.select(F.inline(F.array(*structs)))

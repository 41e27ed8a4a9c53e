"""Out-of-fold scoring: every row is scored by the model that did not see its fold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.probs import softmax
from pairwright.schema import FOLD, ID, PREDS, require
from pairwright.sources.snapshots import publish, versions

LOGITS = ("logit_a", "logit_b", "logit_tie")

#: From a batch of feature columns (pandas) to three logits per row.
Scorer = Callable[["pandas.DataFrame"], "numpy.ndarray"]  # noqa: F821


def score_folds(
    df: DataFrame,
    load_model: Callable[[int], Scorer],
    inputs: Sequence[str],
    keep: Sequence[str] = (ID,),
    fold: str = FOLD,
    one_model_at_a_time: bool = True,
) -> DataFrame:
    """Three logits per row, from one scan over all folds.

    ``load_model(k)`` runs on the executors and returns the scorer of fold ``k``. With
    ``one_model_at_a_time`` the rows of a task are sorted by fold first (no shuffle), so a task
    never holds two large models; otherwise loaded models are kept for the rest of the task. A row without a fold
    keeps its place in the output with NULL logits.
    """
    keep = list(dict.fromkeys([*keep, fold]))
    require(df, [*keep, *inputs], "scoring table")
    columns = list(dict.fromkeys([*keep, *inputs]))
    narrow = df.select(*columns)
    if one_model_at_a_time:
        narrow = narrow.sortWithinPartitions(fold)
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + "".join(f", {c} double" for c in LOGITS)
    input_names, logit_names = list(inputs), list(LOGITS)

    def score(batches):
        models = {}
        for batch in batches:
            for k, rows in batch.groupby(fold, sort=True, dropna=False):
                if k != k or k is None:  # no fold, so no model: the row stays, without logits
                    yield rows[keep].assign(**dict.fromkeys(logit_names, None)).astype(dict.fromkeys(logit_names, float))
                    continue
                if k not in models:
                    if one_model_at_a_time:
                        models.clear()
                    models[k] = load_model(int(k))
                logits = models[k](rows[input_names])
                out = rows[keep].copy()
                for i, name in enumerate(logit_names):
                    out[name] = logits[:, i]
                yield out

    return narrow.mapInPandas(score, schema)


def oof_predictions(scored: DataFrame, keep: Sequence[str] = (ID, FOLD)) -> DataFrame:
    """Probabilities from logits, computed in the JVM."""
    return scored.select(*keep, *[p.alias(name) for p, name in zip(softmax(LOGITS), PREDS)])


def linear_models(coefficients: Mapping[int, Sequence[Sequence[float]]]) -> Callable[[int], Scorer]:
    """A loader for linear scorers: per fold three rows of ``[intercept, weight, ..]``.

    The coefficients travel with the function, which is fine for k small matrices; a large model should be read
    from shared storage inside the loader instead.
    """
    table = {int(k): [list(map(float, row)) for row in rows] for k, rows in coefficients.items()}

    def load(k: int) -> Scorer:
        import numpy as np

        matrix = np.array(table[k])

        def score(batch):
            return matrix[:, 0] + batch.to_numpy(dtype=float) @ matrix[:, 1:].T

        return score

    return load


def text_models(coefficients: Mapping[int, Sequence[Sequence[float]]], text: str = "text") -> Callable[[int], Scorer]:
    """A loader for linear scorers of a text's length (as ``n / (n + 2000)``) and its shares of the letter e and of spaces."""
    linear = linear_models(coefficients)

    def load(k: int) -> Scorer:
        score = linear(k)

        def score_text(batch):
            n = batch[text].str.len()
            some = n.clip(lower=1)
            return score(n.to_frame("n").assign(n=n / (n + 2000), e=batch[text].str.count("e") / some, space=batch[text].str.count(" ") / some))

        return score_text

    return load


#: Upper ends, in characters, of the length ranges of prompts; longer ones make the last range.
LENGTH_RANGES = (1_000, 4_000, 16_000, 64_000)


def score_texts(
    df: DataFrame,
    root: str,
    load_model: Callable[[int], Scorer],
    text: str = "text",
    keep: Sequence[str] = (ID,),
    fold: str = FOLD,
    ranges: Sequence[int] = LENGTH_RANGES,
    on_commit: Callable[[int], None] | None = None,
) -> DataFrame:
    """Score rendered prompts in length ranges; a run that was stopped goes on with the keys that have no scores yet.

    Texts of similar length are scored together, so a model that pads its batches wastes little. Each range is a job of its own, and its
    scores are published below ``root`` in one step when it is complete. A new run over the same ``root`` leaves out every key
    already published (an anti-join on ``keep``, nulls included), whatever ranges that run used. A null text is scored as an empty one.
    Returns the scores of all published ranges. ``on_commit`` is told the number of each range once it is published.
    """
    spark, keep = df.sparkSession, list(keep)
    require(df, [*keep, fold, text], "scoring table")
    prompts = df.select(*keep, fold, F.coalesce(F.col(text), F.lit("")).alias(text)) if fold not in keep else df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))
    done = published_scores(spark, root)
    if done is not None:
        same = [F.col(f"todo.{c}").eqNullSafe(F.col(f"done.{c}")) for c in keep]
        prompts = prompts.alias("todo").join(done.select(*keep).distinct().alias("done"), same, "left_anti")
    size, ends = F.length(text), sorted(ranges)
    bounds = list(zip([None, *ends], [*ends, None]))
    for number, (low, high) in enumerate(bounds):
        inside = (F.lit(True) if low is None else size > low) & (F.lit(True) if high is None else size <= high)
        publish(score_folds(prompts.filter(inside), load_model, [text], keep, fold), root)
        if on_commit:
            on_commit(number)
    return published_scores(spark, root)


def published_scores(spark, root: str) -> DataFrame | None:
    """All scores published below ``root``, or ``None`` where there are none."""
    paths = list(versions(spark, root).values())
    return spark.read.parquet(*paths) if paths else None


def complete_folds(scored: DataFrame, k: int, fold: str = FOLD) -> bool:
    """Whether all ``k`` folds have output."""
    return scored.filter(F.col(fold).between(0, k - 1)).select(fold).distinct().count() == k

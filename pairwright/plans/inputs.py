"""Preference pairs, features, predictions and training logs derived from the given tables.

Spark derives everything below from ``documents`` and ``events``, so its size follows theirs. A pair is a document
(the prompt) with two other documents as responses; the outcome and three models' probabilities follow from
the key by the fixed arithmetic of FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.features import SIDES, combine_measures, text_measures
from pairwright.operators.folds import assign_folds, stratum_by_cluster
from pairwright.schema import CLUSTER, ID, PREDS, TEXTS, WINNERS

MODELS = {m: tuple(f"{m}_{s}" for s in ("a", "b", "tie")) for m in ("m1", "m2", "m3")}

# --- Fixed values: the arithmetic of the fixture. -------------------------------------------------

#: model -> (modulus, remainders below this are misled, shift of the misled class)
HINTS = {"m1": (3, 1, 1), "m2": (5, 2, 2), "m3": (7, 3, 1)}
#: model -> (multiplier, offset, modulus) of the weights of a, b and tie
NOISE = {
    "m1": ((31, 17, 97), (57, 5, 89), (13, 41, 83)),
    "m2": ((43, 11, 79), (71, 3, 73), (29, 23, 71)),
    "m3": ((37, 19, 67), (53, 29, 61), (47, 31, 59)),
}
#: distance, in documents, from a prompt to its responses
RESPONSE_SHIFT = {"a": 1, "b": 7}

# --------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_outcomes(df: DataFrame) -> DataFrame:
    """Add winners and three models' probabilities, which follow from the key.

    One step per layer of the arithmetic, so that Spark evaluates each layer once.
    """
    rest = [c for c in df.columns if c not in (ID, CLUSTER)]
    drawn = df.selectExpr("*", f"({ID} * 7919 + 104729) % 1000 AS _draw")
    known = drawn.selectExpr("*", "CASE WHEN _draw < 350 THEN 0 WHEN _draw < 690 THEN 1 ELSE 2 END AS _y")
    hinted = known.selectExpr(
        "*",
        *[f"CASE WHEN {ID} % {mod} < {below} THEN (_y + {by}) % 3 ELSE _y END AS _h_{m}" for m, (mod, below, by) in HINTS.items()],
    )
    weighted = hinted.selectExpr(
        "*",
        *[
            f"CAST(1 + ({ID} * {mul} + {add}) % {mod} + IF(_h_{m} = {c}, 150, 0) AS DOUBLE) AS _w_{m}_{c}"
            for m, noise in NOISE.items()
            for c, (mul, add, mod) in enumerate(noise)
        ],
    )
    return weighted.selectExpr(
        ID,
        CLUSTER,
        *[f"IF(_y = {c}, 1, 0) AS {name}" for c, name in enumerate(WINNERS)],
        *[f"_w_{m}_{c} / (_w_{m}_0 + _w_{m}_1 + _w_{m}_2) AS {name}" for m, names in MODELS.items() for c, name in enumerate(names)],
        *rest,
    )


def keyed(docs: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(id, cluster, the given columns) of every document; the number in ``source`` is the cluster."""
    cluster = F.substring("source", 4, 20).try_cast("int")
    return docs.select(F.col("doc_id").alias(ID), cluster.alias(CLUSTER), *[c.alias(name) for name, c in columns.items()])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about a pair but its texts; reads two narrow columns."""
    return with_outcomes(keyed(table(spark, sf_dir, "documents"), {}))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with folds stratified by cluster and outcome."""
    return assign_folds(predictions(spark, sf_dir), stratum_by_cluster(), keep_stratum="stratify_group")


def _count(docs: DataFrame) -> Column:
    return docs.agg(F.count(F.lit(1))).scalar()


def pair_measures(spark: SparkSession, sf_dir: str, measures: Mapping[str, Column]) -> DataFrame:
    """(id, outcomes.., p_<measure>.., a_<measure>.., b_<measure>..) for numeric measures of a document.

    Texts are read and measured once and never moved: each document's numbers go to the three pairs it
    serves, and one aggregation puts a pair together.
    """
    docs = table(spark, sf_dir, "documents")
    n, key = _count(docs), F.col(ID)
    served = {"p": key, **{side: F.pmod(key - shift, n) for side, shift in RESPONSE_SHIFT.items()}}
    roles = F.array(*[F.struct(k.alias("_pair"), F.lit(side).alias("_side")) for side, k in served.items()])
    measured = keyed(docs, measures)
    rows = measured.select(F.inline(roles), CLUSTER, *measures)
    together = rows.groupBy(F.col("_pair").alias(ID)).agg(
        F.count(F.lit(1)).alias("_roles"),
        F.expr(f"max(IF(_side = 'p', {CLUSTER}, NULL)) AS {CLUSTER}"),
        *[F.expr(f"max(IF(_side = '{side}', {m}, NULL)) AS {side}_{m}") for side in SIDES for m in measures],
    )
    return with_outcomes(together.filter(f"_roles = {len(SIDES)}").drop("_roles"))


def pairs(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """Pairs with their three texts.

    Each text is moved once per role, to the key of the pair it serves, so both joins use one distribution.
    ``only``, a few keys, cuts every side down before the joins; it is broadcast. ``head`` cuts every text to its first characters where
    it is read, for uses that show no more.
    """
    docs = table(spark, sf_dir, "documents")
    if head is not None:
        docs = docs.withColumn("text", F.substring("text", 1, head))
    n, key = _count(docs), F.col("doc_id")
    prompt, *responses = TEXTS

    def wanted(side: DataFrame) -> DataFrame:
        return side if only is None else side.join(F.broadcast(only.select(ID)), ID, "left_semi")

    out = with_outcomes(wanted(keyed(docs, {prompt: F.col("text")})))
    for name, shift in zip(responses, RESPONSE_SHIFT.values()):
        served = docs.select(F.pmod(key - shift, n).alias(ID), F.col("text").alias(name))
        out = out.join(wanted(served), ID)
    return out


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived features per pair, from measures taken where the texts are."""
    return combine_measures(pair_measures(spark, sf_dir, text_measures("text")), keep=(ID, CLUSTER, *WINNERS))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_measures(spark, sf_dir, {"len": F.length("text").cast("long")})


def dirty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table with NaN, infinities, NULLs, unknown clusters and a redundant cluster column."""
    key = F.col(ID)
    ratio = F.col("a_len").cast("double") / (F.col("b_len") + 1)
    known = lengths(spark, sf_dir).withColumn(CLUSTER, F.when(key % 37 != 0, F.col(CLUSTER)))
    return known.select(
        ID,
        CLUSTER,
        F.col(CLUSTER).alias("cluster_id"),
        F.col("p_len").cast("double").alias("len_p"),
        (F.col("a_len") - F.col("b_len")).cast("double").alias("len_diff"),
        F.when(key % 11 == 0, F.lit(float("inf")))
        .when(key % 13 == 0, F.lit(float("-inf")))
        .when(key % 17 == 0, F.lit(float("nan")))
        .when(key % 19 == 0, F.lit(None).cast("double"))
        .otherwise(ratio)
        .alias("len_ratio"),
        F.when(key % 6 == 0, 1).otherwise(0).alias("is_code_task"),
        *WINNERS,
    )


def model_output(df: DataFrame, model: str) -> DataFrame:
    """One model's predictions as a table of its own."""
    return df.select(ID, *[F.col(c).alias(p) for c, p in zip(MODELS[model], PREDS)])


def misaligned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with missing, repeated and orphan keys."""
    whole = model_output(predictions(spark, sf_dir), "m1")
    key = F.col(ID)
    copies = F.array_compact(
        F.array(
            F.when(key % 50 != 0, key),
            F.when((key % 97 == 0) & (key % 50 != 0), key),
            F.when(key % 89 == 0, key + 1_000_000),
        )
    )
    return whole.select(F.explode(copies).alias(ID), *PREDS)


def gappy(outputs: DataFrame) -> DataFrame:
    """Predictions with a NULL in some rows and a NaN in others."""
    key = F.col(ID)
    first = F.when(key % 29 == 0, F.lit(None).cast("double")).otherwise(F.col(PREDS[0]))
    last = F.when(key % 31 == 0, F.lit(float("nan"))).otherwise(F.col(PREDS[2]))
    return outputs.withColumns({PREDS[0]: first, PREDS[2]: last})


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, run, value): training-log lines of ten runs, some of them unreadable."""
    events = table(spark, sf_dir, "events").select("event_id")
    event = F.col("event_id")
    k = F.floor(event / 10).cast("long") % 20
    loss = ((1100 - 20 * k + (event * 17) % 100) / 1000).cast("decimal(8,3)").cast("string")
    epoch = (k / 10).cast("decimal(6,1)").cast("string")
    run = F.concat(
        F.when(event % 2 == 0, "M1").otherwise("M2"), F.lit("_Fold"), (F.floor(event / 2).cast("long") % 5).cast("string")
    )
    value = (
        F.when(event % 13 == 0, F.lit("plain text, no record"))
        .when(event % 17 == 0, F.concat(F.lit("{'loss': nan, 'epoch': "), epoch, F.lit("}")))
        .when(
            F.floor(event / 10).cast("long") % 3 == 0,
            F.concat(F.lit("step {'eval_loss': "), loss, F.lit(", 'epoch': "), epoch, F.lit("}")),
        )
        .otherwise(F.concat(F.lit("{'loss': "), loss, F.lit(", 'epoch': "), epoch, F.lit("}")))
    )
    return events.select("event_id", run.alias("run"), value.alias("value"))


def with_checkpoints(records: DataFrame) -> DataFrame:
    """Evaluation records with the checkpoint saved at that moment."""
    step = (F.round(F.col("epoch") * 10).cast("long") + 1) * 100
    path = F.concat(F.lit("outputs/"), F.col("run"), F.lit("/checkpoint-"), step.cast("string"))
    return records.filter(F.col("kind") == "eval").withColumn("checkpoint", path)

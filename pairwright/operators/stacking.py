"""Level-2 models on features and out-of-fold probabilities, trained with Spark MLlib.

Families: ``boosted`` (three one-vs-rest gradient-boosted tree models per fold, MLlib's boosting being
binary), ``forest`` (multi-class random forest) and ``logistic`` (multinomial baseline).
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.labels import winner_class
from pairwright.functions.numbers import unusable_to_zero
from pairwright.functions.probs import is_number
from pairwright.operators.encoding import SUFFIXES, fold_encoding
from pairwright.operators.metrics import fold_metrics, mean_of_folds
from pairwright.schema import CLASSES, FOLD, ID, N_FOLDS, PREDS, WINNERS, categorical_columns, require
from pairwright.session import new_path

FAMILIES = ("boosted", "forest", "logistic")
#: Rounds without a better held-out loss after which boosting is cut.
PATIENCE = 50

# --- Fixed values: parameters found by earlier searches, and the ranges those searches drew from. ---

BOOST_PRESETS = {
    "leafwise": {
        "stepSize": 0.0169,
        "maxDepth": 9,
        "featureSubsetStrategy": "0.67",
        "subsamplingRate": 0.88,
        "minInstancesPerNode": 16,
        "maxIter": 1000,
    },
    "depthwise": {
        "stepSize": 0.015,
        "maxDepth": 6,
        "featureSubsetStrategy": "0.867",
        "subsamplingRate": 0.625,
        "minInstancesPerNode": 4,
        "maxIter": 1000,
    },
}

#: name -> (kind, low, high); kinds: float, int, log (log-uniform), fraction (written as text).
SEARCH_SPACES = {
    "leafwise": {
        "stepSize": ("float", 0.01, 0.1),
        "maxDepth": ("int", 4, 10),
        "featureSubsetStrategy": ("fraction", 0.6, 1.0),
        "subsamplingRate": ("float", 0.6, 1.0),
        "minInstancesPerNode": ("int", 10, 100),
    },
    "depthwise": {
        "stepSize": ("float", 0.01, 0.1),
        "maxDepth": ("int", 3, 10),
        "featureSubsetStrategy": ("fraction", 0.6, 1.0),
        "subsamplingRate": ("float", 0.6, 1.0),
        "minInstancesPerNode": ("int", 1, 10),
    },
    "logistic": {"regParam": ("log", 1e-8, 10.0), "elasticNetParam": ("float", 0.0, 1.0)},
    "forest": {
        "maxDepth": ("int", 4, 10),
        "featureSubsetStrategy": ("fraction", 0.6, 1.0),
        "subsamplingRate": ("float", 0.6, 1.0),
        "minInstancesPerNode": ("int", 10, 100),
    },
}

# --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class StackTable:
    """A training table, written once and partitioned by fold, with the steps that assemble its features."""

    path: str
    features: tuple[str, ...]
    k: int
    assembly: PipelineModel
    max_bins: int
    #: rows of the input that belong to none of the folds and so have no model
    left_out: int = 0

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, fold, label, features); assembling is a projection on top of the scan."""
        assembled = self.assembly.transform(spark.read.parquet(self.path))
        return assembled.drop(*self.assembly.stages[-1].getInputCols(), *self.features)


def build_stack_table(
    df: DataFrame,
    features: Sequence[str],
    k: int = N_FOLDS,
    key: str = ID,
    fold: str = FOLD,
    winners: Sequence[str] = WINNERS,
    one_hot: bool = False,
    path: str | None = None,
) -> StackTable:
    """Clean the features and write them with key and label, partitioned by fold; then fit the assembly on that table.

    Every fit reads this table. Written to the shared folder, it cuts the lineage, survives lost executors, and
    lets a fit skip the files of the folds it does not use. Rows are rebalanced by fold first: Spark sizes the
    files by bytes and splits a large fold over many.

    MLlib's trees know no missing value. A number that is NULL, NaN or infinite becomes 0, and a feature that has such values gets a
    column ``<feature>__missing`` of 0 and 1, so trees can tell them from a true 0. Rows without a label are kept: no model learns from
    them, all score them. Rows of no fold in 0..k-1 are counted in ``left_out``. A category becomes the class frequencies of its values in the
    other folds, whatever their number; with ``one_hot`` it becomes a slot per value, which an index holds in memory.
    """
    require(df, [key, fold, *features, *winners], "stacking table")
    categories = categorical_columns(features)
    if categories and not one_hot:
        df = fold_encoding(df, categories, fold, winners)
        features = [x for c in features for x in ([f"{c}__{s}" for s in SUFFIXES] if c in categories else [c])]
        categories = []
    plain = [c for c in features if c not in categories]
    inside = F.coalesce(F.col(fold).between(0, k - 1), F.lit(False))
    unusable = {c: ~is_number(c) for c in plain}
    seen = df.agg(
        F.count_if(~inside).alias("left_out"),
        *[F.count_if(u).alias(f"u{i}") for i, u in enumerate(unusable.values())],
    ).first()
    gaps = [c for i, c in enumerate(plain) if seen[f"u{i}"]]
    features = [*features, *[f"{c}__missing" for c in gaps]]
    typed = df.filter(inside).select(
        key,
        F.col(fold).cast("int").alias(fold),
        winner_class(winners).cast("double").alias("label"),
        *[F.col(c).cast("string").alias(c) for c in categories],
        *[unusable_to_zero(F.col(c).cast("double")).alias(c) for c in plain],
        *[unusable[c].cast("double").alias(f"{c}__missing") for c in gaps],
    )
    stages, inputs = [], list(features)
    if categories:
        indexed = [f"{c}__index" for c in categories]
        stages.append(StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=[f"{c}__hot" for c in categories]))
        inputs = [f"{c}__hot" if c in categories else c for c in features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    path = path or new_path(df.sparkSession, "stack")
    typed.hint("rebalance", fold).write.partitionBy(fold).parquet(path)
    assembly = Pipeline(stages=stages).fit(df.sparkSession.read.parquet(path))
    return StackTable(path, tuple(features), k, assembly, 32, seen["left_out"])


def fit_fold_models(
    spark: SparkSession,
    table: StackTable,
    family: str = "forest",
    params: Mapping[str, object] | None = None,
    seed: int = 42,
    parallelism: int = 4,
    patience: int = PATIENCE,
) -> dict[int, list[Model]]:
    """One model per fold (three for ``boosted``), each trained on the labelled rows of the other folds.

    Boosting is cut after the best round on the fold it will predict, looking no further than ``patience`` rounds past it, as the
    stacker it replaces did; MLlib has no patience, so all rounds are fitted first (:func:`rounds_kept` tells what stayed).
    Independent fits are submitted from a few threads, so the cluster works on several at once, and share one assembled table in memory.
    """
    data = table.read(spark).filter(F.col("label").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = [(k, c) for k in range(table.k) for c in (CLASSES if family == "boosted" else (None,))]

    def fit(task: tuple[int, int | None]) -> Model:
        k, c = task
        if family == "boosted":
            rows = data.withColumn("label", (F.col("label") == c).cast("double"))
            model = GBTClassifier(seed=seed, maxBins=table.max_bins).setParams(**(params or {})).fit(rows.filter(F.col(FOLD) != k))
            held = rows.filter(F.col(FOLD) == k)
            return cut_rounds(model, best_round(model.evaluateEachIteration(held), patience)) if not held.isEmpty() else model
        if family not in FAMILIES:
            raise ValueError(f"family is one of {FAMILIES}")
        rows = data.filter(F.col(FOLD) != k)
        if family == "forest":
            learner = RandomForestClassifier(seed=seed, maxBins=table.max_bins)
        else:
            learner = LogisticRegression(family="multinomial")
        return learner.setParams(**(params or {})).fit(rows)

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            fitted = list(pool.map(fit, tasks))
    finally:
        data.unpersist()
    models: dict[int, list[Model]] = {}
    for (k, _), model in zip(tasks, fitted):
        models.setdefault(k, []).append(model)
    return models


def best_round(losses: Sequence[float], patience: int) -> int:
    """Rounds up to the best one that is reached before ``patience`` rounds bring nothing better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cut_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model made of its first trees only."""
    java = model._java_obj
    trees, weights = list(java.trees())[:rounds], list(java.treeWeights())[:rounds]
    context = SparkContext._active_spark_context
    array = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    numbers = context._gateway.new_array(context._jvm.double, len(weights))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        array[i], numbers[i] = tree, weight
    short = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), array, numbers, model.numFeatures, model.numClasses)
    return GBTClassificationModel(java.copyValues(short, java.extractParamMap()) if hasattr(java, "copyValues") else short)


def rounds_kept(models: Mapping[int, Sequence[Model]]) -> dict[int, list[int]]:
    """Trees per fold and class of boosted models."""
    return {k: [m.getNumTrees for m in of_fold] for k, of_fold in models.items()}


def save_models(models: Mapping[int, Sequence[Model]], path: str, parallelism: int = 8) -> str:
    """One folder per fold and model."""
    places = [(model, f"{path}/fold={k}/model={i}") for k, of_fold in models.items() for i, model in enumerate(of_fold)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(lambda place: place[0].write().save(place[1]), places))
    return path


def load_models(path: str, family: str, k: int = N_FOLDS, parallelism: int = 8) -> dict[int, list[Model]]:
    reader = {
        "boosted": GBTClassificationModel,
        "forest": RandomForestClassificationModel,
        "logistic": LogisticRegressionModel,
    }[family]
    per_fold = len(CLASSES) if family == "boosted" else 1
    places = [f"{path}/fold={f}/model={i}" for f in range(k) for i in range(per_fold)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        loaded = list(pool.map(reader.load, places))
    return {f: loaded[f * per_fold : (f + 1) * per_fold] for f in range(k)}


def stack_predictions(data: DataFrame, models: Mapping[int, Sequence[Model]], keep: Sequence[str] = (ID,)) -> DataFrame:
    """Out-of-fold probabilities: each fold's rows through that fold's models.

    The table is partitioned by fold, so the branches of the union read disjoint files.
    """
    parts = [_predict(data.filter(F.col(FOLD) == k), of_fold, keep).withColumn(FOLD, F.lit(k)) for k, of_fold in models.items()]
    return reduce(DataFrame.unionByName, parts)


def _predict(rows: DataFrame, models: Sequence[Model], keep: Sequence[str]) -> DataFrame:
    if len(models) == 1:
        scored = models[0].transform(rows).withColumn("_p", vector_to_array("probability"))
        return scored.select(*keep, *[F.col("_p")[i].alias(name) for i, name in enumerate(PREDS)])
    scored = rows.select(*keep, "features")
    for i, model in enumerate(models):
        model = model.copy({model.probabilityCol: f"_p{i}", model.rawPredictionCol: f"_r{i}", model.predictionCol: f"_y{i}"})
        scored = model.transform(scored).withColumn(f"_c{i}", vector_to_array(f"_p{i}")[1])
    total = F.col("_c0") + F.col("_c1") + F.col("_c2")
    return scored.select(
        *keep, *[F.when(total > 0, F.col(f"_c{i}") / total).otherwise(F.lit(1.0 / 3)).alias(n) for i, n in enumerate(PREDS)]
    )


def level2_oof(spark: SparkSession, table: StackTable, path: str, family: str) -> DataFrame:
    """Regenerate level-2 predictions from saved models: ``(id, pred_a, pred_b, pred_tie)``."""
    return stack_predictions(table.read(spark), load_models(path, family, table.k)).select(*PREDS, ID)


def cv_score(data: DataFrame, models: Mapping[int, Sequence[Model]], k: int) -> float:
    """Unweighted mean of the fold log losses."""
    predicted = stack_predictions(data.filter(F.col("label").isNotNull()), models, keep=("label",))
    winners = [F.when(F.col("label") == c, 1).otherwise(0).alias(w) for c, w in zip(CLASSES, WINNERS)]
    labelled = predicted.select(FOLD, *PREDS, *winners)
    return mean_of_folds(fold_metrics(labelled, {"m": PREDS}, k)).first()["mean_log_loss"]


def draw_params(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """``n`` random parameter sets."""
    rng = random.Random(seed)
    kinds = {
        "float": rng.uniform,
        "int": rng.randint,
        "log": lambda lo, hi: math.exp(rng.uniform(math.log(lo), math.log(hi))),
        "fraction": lambda lo, hi: f"{rng.uniform(lo, hi):.3f}",
    }
    return [{name: kinds[kind](lo, hi) for name, (kind, lo, hi) in space.items()} for _ in range(n)]


def search(
    spark: SparkSession,
    table: StackTable,
    family: str,
    space: Mapping[str, tuple],
    trials: int = 50,
    seed: int = 42,
    fixed: Mapping[str, object] | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """(trial, parameters, mean_log_loss), best first; one row per trial. ``parallelism`` trials run at the same time."""
    data = table.read(spark)

    def trial(task: tuple[int, dict]) -> tuple[int, str, float]:
        i, drawn = task
        models = fit_fold_models(spark, table, family, {**drawn, **(fixed or {})}, seed, parallelism)
        return i, json.dumps(drawn, sort_keys=True), float(cv_score(data, models, table.k))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        results = list(pool.map(trial, enumerate(draw_params(space, trials, seed))))
    found = spark.createDataFrame(results, "trial int, parameters string, mean_log_loss double")
    return found.orderBy("mean_log_loss", "trial")


def best_parameters(found: DataFrame) -> dict:
    """The parameters of the best trial, ready for :func:`fit_fold_models`."""
    return json.loads(found.orderBy("mean_log_loss", "trial").first()["parameters"])


def slots_of(table: StackTable, spark: SparkSession) -> list[str]:
    """The feature behind every slot of the assembled vector; an encoded category has several."""
    assembled = table.read(spark).schema["features"].metadata["ml_attr"]
    slots = [""] * assembled["num_attrs"]
    for group in assembled["attrs"].values():
        for attribute in group:
            slots[attribute["idx"]] = attribute["name"]
    inputs = sorted(table.assembly.stages[-1].getInputCols(), key=len, reverse=True)
    owners = [next(c for c in inputs if name == c or name.startswith(c + "_")) for name in slots]
    return [o.removesuffix("__hot").removesuffix("__index") for o in owners]


def importances(spark: SparkSession, models: Mapping[int, Sequence[Model]], features: Sequence[str], missing: str = "zero") -> DataFrame:
    """(fold, feature, importance) of tree models; the three models of a boosted fold are averaged.

    ``features`` names the feature of every slot of the vector: the table's features, or :func:`slots_of` a table with one-hot
    categories, whose slots are summed. ``missing='skip'`` leaves out features a model never splits on; ``'zero'`` reports them as 0.
    """
    if missing not in ("zero", "skip"):
        raise ValueError("missing is 'zero' or 'skip'")
    rows = []
    for k, of_fold in models.items():
        if any(m.numFeatures != len(features) for m in of_fold):
            raise ValueError(f"{len(features)} names for {of_fold[0].numFeatures} slots; see slots_of")
        total = dict.fromkeys(features, 0.0)
        for m in of_fold:
            for i, x in enumerate(m.featureImportances.toArray()):
                total[features[i]] += float(x) / len(of_fold)
        for name, value in total.items():
            if value > 0 or missing == "zero":
                rows.append((k, name, value))
    return spark.createDataFrame(rows, "fold int, feature string, importance double")


def mean_importance(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("feature").agg(F.avg("importance").alias("importance"))


def top_features(mean: DataFrame, n: int = 10) -> DataFrame:
    return mean.orderBy(F.desc("importance"), "feature").limit(n)

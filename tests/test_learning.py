import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import scoring, stacking
from pairwright.schema import PREDS, WINNERS


@pytest.fixture(scope="module")
def labelled(spark):
    """400 rows whose class follows from x; every feature but noise is informative."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        y = 0 if x < -0.4 else 1 if x < 0.4 else 2
        rows.append((i, i % 5, *[int(y == c) for c in range(3)], x if i % 50 else float("nan"), float(rng.normal()), int(y) * 7, "t"))
    return spark.createDataFrame(rows, "id long, fold int, winner_model_a int, winner_model_b int, winner_tie int, x double, noise double, cluster_id_k20 int, prompt_text string")


def test_rows_are_scored_by_the_model_of_their_fold(spark):
    df = spark.range(100, numPartitions=3).withColumn("fold", (F.col("id") % 5).cast("int")).withColumn("x", F.col("id").cast("double"))
    models = {k: [[k, 0.0], [0.0, 1.0], [0.0, k]] for k in range(5)}
    for one_at_a_time in (True, False):
        scored = scoring.score_folds(df, scoring.linear_models(models), ["x"], one_model_at_a_time=one_at_a_time)
        rows = scored.collect()
        assert len(rows) == 100 and len({r["id"] for r in rows}) == 100
        assert all((r["logit_a"], r["logit_b"], r["logit_tie"]) == (r["fold"], r["id"], r["fold"] * r["id"]) for r in rows)
    probs = scoring.oof_predictions(scored).collect()
    assert all(abs(sum(r[p] for p in PREDS) - 1) < 1e-9 for r in probs)
    assert scoring.complete_folds(scored, 5) and not scoring.complete_folds(scored, 6)


@pytest.fixture(scope="module")
def table(labelled):
    return stacking.build_stack_table(labelled, ["x", "noise", "cluster_id_k20"])


@pytest.mark.parametrize(
    ("family", "params"),
    [("boosted", {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5}), ("forest", {"numTrees": 5}), ("logistic", {"maxIter": 10})],
)
def test_level_two_predictions(spark, labelled, table, family, params):
    models = stacking.fit_fold_models(spark, table, family, params)
    assert {k: len(v) for k, v in models.items()} == dict.fromkeys(range(5), 3 if family == "boosted" else 1)
    path = stacking.save_models(models, f"{table.path}-{family}")
    oof = stacking.level2_oof(spark, table, path, family)
    assert oof.columns == [*PREDS, "id"]
    rows = oof.collect()
    assert sorted(r["id"] for r in rows) == list(range(400))
    assert all(abs(sum(r[p] for p in PREDS) - 1) < 1e-9 for r in rows)
    direct = {r["id"]: r for r in stacking.stack_predictions(table.read(spark), models).collect()}
    assert all(abs(r[p] - direct[r["id"]][p]) < 1e-12 for r in rows for p in PREDS)
    truth = {r["id"]: [r[w] for w in WINNERS].index(1) for r in labelled.collect()}
    hits = sum(int(np.argmax([r[p] for p in PREDS]) == truth[r["id"]]) for r in rows)
    assert hits > 300


def test_models_do_not_see_their_fold(spark, labelled):
    """With fold 0's labels replaced, fold 0's own predictions stay the same."""
    swapped = labelled.withColumns({w: F.when(F.col("fold") == 0, int(w == "winner_tie")).otherwise(F.col(w)) for w in WINNERS})
    got = []
    for df in (labelled, swapped):
        table = stacking.build_stack_table(df, ["x", "noise"])
        models = stacking.fit_fold_models(spark, table, "logistic", {"maxIter": 5})
        got.append({r["id"]: round(r["pred_a"], 9) for r in stacking.stack_predictions(table.read(spark).filter("fold = 0"), models).collect()})
    assert got[0] == got[1] and len(got[0]) == 80


def test_search_ranks_its_trials(spark, table):
    found = stacking.search(spark, table, "logistic", stacking.SEARCH_SPACES["logistic"], trials=3, fixed={"maxIter": 5}).collect()
    losses = [r["mean_log_loss"] for r in found]
    assert len(found) == 3 and losses == sorted(losses)
    assert set(json.loads(found[0]["parameters"])) == {"regParam", "elasticNetParam"}
    assert stacking.draw_params(stacking.SEARCH_SPACES["leafwise"], 4) == stacking.draw_params(stacking.SEARCH_SPACES["leafwise"], 4)


def test_patience_cuts_after_the_best_round():
    assert stacking.best_round([5, 4, 3, 3.5, 3.6, 2], 2) == 3
    assert stacking.best_round([5, 4, 3, 3.5, 3.6, 2], 3) == 6
    assert stacking.best_round([1.0], 50) == 1


def test_cut_models_equal_shorter_fits(spark, table):
    long = stacking.fit_fold_models(spark, table, "boosted", {"maxIter": 6, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 1.0})
    model = long[0][0]
    short = stacking.cut_rounds(model, 2)
    assert short.getNumTrees == 2 and short.numFeatures == model.numFeatures
    rows = table.read(spark)
    losses = [m.evaluateEachIteration(rows.withColumn("label", (F.col("label") == 0).cast("double"))) for m in (model, short)]
    assert losses[1] == pytest.approx(losses[0][:2])
    assert all(1 <= n <= 6 for kept in stacking.rounds_kept(long).values() for n in kept)


def test_rows_without_label_or_fold(spark, labelled):
    odd = labelled.withColumns({w: F.when(F.col("id") != 7, F.col(w)) for w in WINNERS})
    odd = odd.withColumn("fold", F.when(F.col("id") == 8, 9).when(F.col("id") != 9, F.col("fold")))
    table = stacking.build_stack_table(odd, ["x", "noise"])
    models = stacking.fit_fold_models(spark, table, "logistic", {"maxIter": 3})
    ids = {r["id"] for r in stacking.stack_predictions(table.read(spark), models).collect()}
    assert table.left_out == 2 and ids == set(range(400)) - {8, 9}
    assert table.features == ("x", "noise", "x__missing")


def test_one_hot_importances_are_summed(spark, labelled):
    data = labelled.withColumn("constant", F.lit(1.0))
    table = stacking.build_stack_table(data, ["cluster_id_k20", "constant", "x"], one_hot=True)
    slots = stacking.slots_of(table, spark)
    assert slots.count("cluster_id_k20") > 1 and slots.count("x") == 1
    models = stacking.fit_fold_models(spark, table, "forest", {"numTrees": 5})
    mean = {r["feature"]: r["importance"] for r in stacking.mean_importance(stacking.importances(spark, models, slots)).collect()}
    assert mean["constant"] == 0 and mean["cluster_id_k20"] > 0.3 and sum(mean.values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        stacking.importances(spark, models, table.features)


def test_importances(spark, table):
    models = stacking.fit_fold_models(spark, table, "forest", {"numTrees": 5})
    every = stacking.importances(spark, models, table.features)
    assert every.count() == 30  # with the indicator of missing x and three columns for the cluster
    top = [r["feature"] for r in stacking.top_features(stacking.mean_importance(every), 2).collect()]
    assert "noise" not in top
    with pytest.raises(ValueError):
        stacking.importances(spark, models, table.features, missing="drop")
    assert stacking.importances(spark, models, table.features, "skip").filter("importance = 0").count() == 0

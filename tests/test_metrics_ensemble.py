import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import density, distill, ensemble, metrics

SCHEMA = "id long, fold int, cluster_id_k20 int, winner_model_a int, winner_model_b int, winner_tie int, m_a double, m_b double, m_tie double"
M = {"m": ("m_a", "m_b", "m_tie")}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return table(
        spark,
        [
            (1, 0, 3, 1, 0, 0, 0.7, 0.2, 0.1),
            (2, 0, 3, 0, 1, 0, 0.5, 0.4, 0.1),
            (3, 2, 4, 0, 0, 1, 0.2, 0.2, 0.6),
            (4, 2, 4, 0, 0, 1, float("nan"), 0.5, 0.5),
            (5, 2, 4, 0, 1, 0, 0.2, float("nan"), 0.6),
        ],
    )


def test_overall_metrics(small):
    row = metrics.model_metrics(small, M).first()
    # rows 4 and 5 have a NaN, so they count nowhere
    losses = [-math.log(p) for p in (0.7, 0.4, 0.6)]
    assert row["accuracy"] == pytest.approx(2 / 3)
    assert row["n"] == 3 and row["log_loss"] == pytest.approx(np.mean(losses))


@pytest.mark.parametrize("bad", [(1, 0, 0, None, 0.5, 0.5), (1, 0, 0, 0.5, None, 0.5), (1, 0, 0, 0.3, 0.3, float("nan")), (None, None, None, 0.2, 0.2, 0.6), (0, 1, 0, 0.1, float("inf"), 0.1)])
def test_a_row_with_a_gap_changes_nothing(spark, bad):
    good = [(k, 0, 3, int(k % 3 == 0), int(k % 3 == 1), int(k % 3 == 2), 0.5, 0.3, 0.2) for k in range(9)]
    clean, flawed = table(spark, good), table(spark, [*good, (9, None, None, *bad)])
    for measure in (metrics.model_metrics, metrics.logit_metrics, lambda df, m: ensemble.blend_metrics(df, m, {"m": 1.0})):
        for one, other in zip(measure(clean, M).orderBy("model").collect(), measure(flawed, M).orderBy("model").collect()):
            assert one["n"] == other["n"] == 9 and list(one)[2:] == pytest.approx(list(other)[2:])
    two = {"m": M["m"], "n": M["m"][1:] + M["m"][:1]}
    one, other = ensemble.fit_blend(clean, two), ensemble.fit_blend(flawed, two)
    assert one.weights == pytest.approx(other.weights) and one.log_loss == pytest.approx(other.log_loss) and one.converged and other.converged
    grids = [{tuple(r)[:2]: r["log_loss"] for r in ensemble.ensemble_grid(df, two, 4).collect()} for df in (clean, flawed)]
    assert grids[0] == pytest.approx(grids[1])


def test_rows_without_a_fold_are_reported(small):
    rows = metrics.fold_metrics(small.withColumn("fold", F.when(F.col("id") > 1, F.lit(None).cast("int")).otherwise(7)), M).collect()
    assert {(r["fold"], r["n"]) for r in rows} == {(None, 2), (7, 1), *((k, 0) for k in range(5))}


def test_an_unfinished_fit_says_so(spark):
    df = table(spark, [(k, 0, 3, int(k % 3 == 0), int(k % 3 == 1), int(k % 3 == 2), 0.5, 0.3, 0.2) for k in range(9)])
    two = {"m": M["m"], "n": M["m"][1:] + M["m"][:1]}
    assert not ensemble.fit_blend(df, two, max_passes=1).converged


def test_a_missing_teacher_has_no_loss(spark):
    schema = "winner_model_a int, winner_model_b int, winner_tie int, a double, b double, t double, teacher_a double, teacher_b double, teacher_tie double"
    good = (1, 0, 0, 1.0, 0.5, 0.1, 0.6, 0.3, 0.1)
    one = {r["mode"]: r for r in distill.distill_loss(spark.createDataFrame([good], schema), ("a", "b", "t")).collect()}
    for gap in (None, float("nan")):
        bad = spark.createDataFrame([good, (*good[:6], 0.6, gap, 0.4), (None, None, None, *good[3:])], schema)
        for r in distill.distill_loss(bad, ("a", "b", "t")).collect():
            assert r["n"] == 1 and r["loss"] == pytest.approx(one[r["mode"]]["loss"]) and r["soft_loss"] == pytest.approx(one[r["mode"]]["soft_loss"])


def test_empty_folds_are_reported(small):
    rows = {r["fold"]: r for r in metrics.fold_metrics(small, M).collect()}
    assert set(rows) == {0, 1, 2, 3, 4}
    assert rows[1]["n"] == 0 and rows[1]["log_loss"] is None
    assert metrics.mean_of_folds(metrics.fold_metrics(small, M)).first()["n_folds"] == 2


def test_empty_folds_score_ten_in_weights(small):
    rows = {r["fold"]: r for r in metrics.fold_softmax_weights(metrics.fold_metrics(small, M)).collect()}
    assert rows[1]["score"] == 10.0 and rows[1]["weight"] < 1e-50
    assert sum(r["weight"] for r in rows.values()) == pytest.approx(1.0)


def test_confusion_is_dense(small):
    rows = {(r["true_class"], r["pred_class"]): r for r in metrics.confusion_matrix(small, M).collect()}
    assert len(rows) == 9 and rows[(1, 0)]["n"] == 1 and rows[(0, 2)]["n"] == 0
    report = {r["class"]: r for r in metrics.class_report(small, M).collect()}
    # rows with a NaN have no class, so rows 1 and 2 are predicted to be class 0
    assert report[0]["precision"] == pytest.approx(1 / 2) and report[0]["recall"] == 1.0


def test_cluster_loss_has_the_overall_line(small):
    clean = small.filter("id < 4")
    rows = {r["cluster_id_k20"]: r for r in metrics.cluster_loss(clean, M).collect()}
    overall = np.mean([-math.log(p) for p in (0.7, 0.4, 0.6)])
    assert rows[3]["m_loss"] == pytest.approx(np.mean([-math.log(0.7), -math.log(0.4)]))
    assert {round(r["m_overall"], 9) for r in rows.values()} == {round(overall, 9)}


def random_models(spark, n, k, favourite=None, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    rows = []
    for i in range(n):
        row = [i, *[int(y[i] == c) for c in range(3)]]
        for m in range(k):
            p = rng.dirichlet(np.ones(3) + 6 * np.eye(3)[y[i] if (favourite == m or rng.random() < 0.5) else rng.integers(0, 3)])
            row += [float(v) for v in p]
        rows.append(tuple(row))
    models = {f"m{m}": tuple(f"m{m}_{s}" for s in ("a", "b", "tie")) for m in range(k)}
    schema = "id long, winner_model_a int, winner_model_b int, winner_tie int, " + ", ".join(f"{c} double" for cols in models.values() for c in cols)
    return spark.createDataFrame(rows, schema), models


def brute_force(df, models, steps):
    names = list(models)
    rows = ensemble.true_class_probs(df, models).toPandas()[names].to_numpy()
    grid = np.array(ensemble.simplex_grid(len(names), steps))
    losses = -np.log(np.maximum(rows @ grid.T, 1e-15)).mean(axis=0)
    return grid[losses.argmin()], losses.min(), losses


def test_grid_equals_brute_force(spark):
    df, models = random_models(spark, 200, 3)
    got = {tuple(r[f"w_{m}"] for m in models): r["log_loss"] for r in ensemble.ensemble_grid(df, models, 10).collect()}
    _, _, losses = brute_force(df, models, 10)
    assert len(got) == 66
    assert [got[w] for w in ensemble.simplex_grid(3, 10)] == pytest.approx(losses.tolist())


@pytest.mark.parametrize("favourite", [None, 1])
def test_newton_beats_the_grid(spark, favourite):
    df, models = random_models(spark, 300, 3, favourite)
    fit = ensemble.fit_blend(df, models)
    _, best, _ = brute_force(df, models, 50)
    assert fit.log_loss <= best + 1e-9 and fit.gap <= 1e-8 and sum(fit.weights.values()) == pytest.approx(1.0)
    single = [r["log_loss"] for r in ensemble.blend_metrics(df, models, fit.weights).filter("model <> 'blend'").collect()]
    assert fit.log_loss <= min(single) + 1e-12


def test_corner_optimum(spark):
    df, models = random_models(spark, 300, 1, favourite=0)
    worse = df.withColumns({"x_a": F.col("m0_b"), "x_b": F.col("m0_tie"), "x_tie": F.col("m0_a")})
    fit = ensemble.fit_blend(worse, {**models, "x": ("x_a", "x_b", "x_tie")})
    assert fit.gap <= 1e-8 and fit.weights["m0"] > 0.8


def test_identical_models(spark):
    df, models = random_models(spark, 100, 1)
    twice = {"m0": models["m0"], "again": models["m0"]}
    fit = ensemble.fit_blend(df, twice)
    assert sum(fit.weights.values()) == pytest.approx(1.0) and fit.gap <= 1e-10


def test_density_is_close_to_the_exact_kernel(spark):
    df, models = random_models(spark, 500, 1)
    p = np.array([r[0] for r in df.select("m0_a").collect()])
    bw = p.std(ddof=1) * len(p) ** (-0.2)
    rows = density.confidence_density(df, {"m0": "m0_a"}).orderBy("point").collect()
    x = np.linspace(p.min() - 3 * bw, p.max() + 3 * bw, 200)
    exact = np.exp(-0.5 * ((x[:, None] - p[None, :]) / bw) ** 2).sum(axis=1) / (len(p) * bw * math.sqrt(2 * math.pi))
    assert [r["x"] for r in rows] == pytest.approx(x.tolist())
    assert np.abs(np.array([r["density"] for r in rows]) - exact).max() < 1e-5


def test_distillation_loss_by_hand(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 2.0, 1.0, 0.0, 0.7, 0.2, 0.1)],
        "winner_model_a int, winner_model_b int, winner_tie int, l0 double, l1 double, l2 double, teacher_a double, teacher_b double, teacher_tie double",
    )
    z, t = np.array([2.0, 1.0, 0.0]), np.array([0.7, 0.2, 0.1])
    hard = -(z[0] - np.log(np.exp(z).sum()))
    log_q = z / 2 - np.log(np.exp(z / 2).sum())
    rows = {r["mode"]: r for r in distill.distill_loss(df, ("l0", "l1", "l2")).collect()}
    for mode, target in (("as_is", np.exp(t / 2) / np.exp(t / 2).sum()), ("renormalised", np.sqrt(t) / np.sqrt(t).sum())):
        soft = 4 * (target * (np.log(target) - log_q)).sum()
        assert rows[mode]["hard_loss"] == pytest.approx(hard)
        assert rows[mode]["soft_loss"] == pytest.approx(soft)
        assert rows[mode]["loss"] == pytest.approx(0.5 * hard + 0.5 * soft)

"""Boosting against a plain version that grows one tree at a time, search, saved models, gains and encodings."""

import glob
import heapq
import inspect
import json
import math
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import boosting as b
from pairwright.operators.encoding import fold_encoding
from pairwright.plans import catalog, inputs
from pairwright.schema import PREDS, WINNERS
from pairwright.session import shared_root

FEATURES = ("x", "z", "noise")
EDGES = ((-1.0, -0.5, 0.0, 0.4, 1.0), (0.0, 1.0, 2.0), tuple(np.linspace(-2, 2, 9)))


def rows(n=500, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, z = float(rng.normal()), float(rng.integers(0, 4))
        y = int((x > 0) + (x > 0.7)) if z else int(rng.integers(0, 3))
        out.append((i, i % 5, *[int(y == c) for c in range(3)], x if i % 7 else None, z, float(rng.normal()) if i % 11 else float("inf")))
    return out


@pytest.fixture(scope="module")
def data(spark):
    fields = "id long, fold int, winner_model_a int, winner_model_b int, winner_tie int, x double, z double, noise double"
    return spark.createDataFrame(rows(), fields).persist()


def bins_of(value, edges):
    return 0 if value is None or not math.isfinite(value) else 1 + sum(value > e for e in edges)


def plain_fit(table, fold, p, rounds, seed, name, priors):
    """One model, leaf by leaf: ``[(splits, {leaf rows: value}), ..]`` per round and class, and the held-out losses."""
    x = [[bins_of(r[5 + i], EDGES[i]) for i in range(3)] for r in table]
    y = [r[2:5].index(1) for r in table]
    margin = [list(priors) for _ in table]
    train = [i for i, r in enumerate(table) if r[1] != fold]
    out, losses = [], []
    keys = b_row_hash(table)

    def soft(v):
        e = [math.exp(a - max(v)) for a in v]
        return [a / sum(e) for a in e]

    def score(g, h):
        return max(abs(g) - p.lambda_l1, 0) ** 2 / (h + p.lambda_l2)

    for at in range(rounds):
        bag = b.in_bag(keys, p, seed, at)
        use = [i for i in train if bag[i]]
        probs = [soft(v) for v in margin]
        steps = []
        for c in range(3):
            g = {i: round((probs[i][c] - (y[i] == c)) * b.SCALE) for i in use}
            h = {i: round(max(p.hessian * probs[i][c] * (1 - probs[i][c]), 1e-9) * b.SCALE) for i in use}
            cols = b.sampled_features(3, p.feature_fraction, seed, name, fold, at, c)

            def best(members, depth):
                if depth >= p.max_depth:
                    return None
                found = None
                total = [sum(w[i] for i in members) / b.SCALE for w in (g, h)]
                for f in cols:
                    for cut in range(1, len(EDGES[f]) + 2):
                        for side in (False, True):
                            left = [i for i in members if (side if x[i][f] == 0 else x[i][f] <= cut)]
                            lg, lh = (sum(w[i] for i in left) / b.SCALE for w in (g, h))
                            n = len(left), len(members) - len(left)
                            if min(n) < p.min_child_samples or min(lh, total[1] - lh) < p.min_child_weight:
                                continue
                            gain = score(lg, lh) + score(total[0] - lg, total[1] - lh) - score(*total)
                            if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                                found = (gain, int(f), cut, side, left, [i for i in members if i not in set(left)])
                return found

            leaves, heap, splits = {0: (use, 0)}, [], []
            number = 1
            if s := best(use, 0):
                heap = [(-s[0], 0, s)]
            while heap and len(leaves) < (p.num_leaves or 1 << p.max_depth):
                _, k, s = heapq.heappop(heap)
                depth = leaves.pop(k)[1]
                splits.append((s[1], s[2], s[3], round(s[0], 6)))
                for part in s[4:]:
                    leaves[number] = (part, depth + 1)
                    if t := best(part, depth + 1):
                        heapq.heappush(heap, (-t[0], number, t))
                    number += 1
            values = {}
            for members, _ in leaves.values():
                sg, sh = (sum(w[i] for i in members) / b.SCALE for w in (g, h))
                values[tuple(members)] = -math.copysign(max(abs(sg) - p.lambda_l1, 0), sg) / (sh + p.lambda_l2) * p.learning_rate
            steps.append((splits, values))
        out.append(steps)
        yield steps, use


def b_row_hash(table):
    return np.array([HASHES[r[0]] for r in table], np.int64)


HASHES = {}


@pytest.fixture(scope="module", autouse=True)
def hashes(spark, data):
    HASHES.update({r["id"]: r["h"] for r in data.select("id", F.xxhash64("id").alias("h")).collect()})


LEAFWISE = b.Boost(learning_rate=0.3, num_leaves=6, max_depth=4, feature_fraction=0.67, bagging_fraction=0.8, min_child_samples=5, lambda_l1=0.01, lambda_l2=0.5)
DEPTHWISE = b.Boost(learning_rate=0.3, max_depth=3, min_child_weight=2.0, lambda_l2=1.0, hessian=2.0)


@pytest.mark.parametrize("params", [LEAFWISE, DEPTHWISE])
def test_first_trees_equal_a_plain_version(spark, data, params):
    table = b.bin_table(data, FEATURES, edges=EDGES)
    fleet = b.Fleet(spark, table, [b.Member("m", 2, params)])
    fleet.run(1)
    steps, use = next(plain_fit(rows(), 2, params, 1, 42, "m", fleet.priors[0]))
    x = np.array([[bins_of(r[5 + i], EDGES[i]) for i in range(3)] for r in rows()])
    for tree, (splits, values) in zip(fleet.trees[0][0], steps):
        inner = tree.feature >= 0
        got = sorted(zip(tree.feature[inner].tolist(), tree.bin[inner].tolist(), tree.missing_left[inner].tolist(), np.round(tree.gain[inner], 6).tolist()))
        assert got == sorted(splits) and len(splits) >= 3
        at = tree.leaves(x)
        for members, value in values.items():
            leaf = {int(at[i]) for i in members}
            assert len(leaf) == 1 and tree.value[leaf.pop()] == pytest.approx(value, abs=1e-9)
    fleet.close()


def shape(tree):
    return [np.asarray(v).tolist() for v in (tree.feature, tree.bin, tree.missing_left, tree.left, tree.right, tree.value, tree.gain, tree.n)]


def test_trees_do_not_depend_on_partitions(spark, data):
    """One partition grows whole rounds, several grow in waves with a shuffle; block sizes and row order differ as well."""
    members = [b.Member("l", 0, LEAFWISE), b.Member("l", 3, LEAFWISE), b.Member("d", 1, DEPTHWISE)]
    fleets = []
    for size, table in ((1 << 18, data), (180, data.orderBy(F.rand(5)).repartition(7))):
        made = b.bin_table(table, FEATURES, edges=EDGES, partition_rows=size)
        fleets.append(b.Fleet(spark, made, members).run(14))  # past a refresh of the margins
        assert made.parts == (1 if size > 500 else 3)
    one, many = fleets
    assert [[[shape(t) for t in r] for r in m] for m in one.trees] == [[[shape(t) for t in r] for r in m] for m in many.trees]
    assert one.losses == many.losses and all(len(x) == 14 for x in one.losses)
    assert all(x[-1] < x[0] < math.log(3) + 0.1 for x in one.losses)
    for f in fleets:
        f.close()


def test_margins_are_stored_for_growing_models_of_waves_only(spark, data):
    members = [b.Member("l", 0, LEAFWISE), b.Member("l", 3, LEAFWISE), b.Member("d", 1, DEPTHWISE)]
    stored = lambda: len(glob.glob(f"{shared_root(spark).removeprefix('file:')}/pairwright/margins-*"))
    before, made = stored(), []
    for size, written in ((1 << 18, 0), (180, 1)):
        fleet = b.Fleet(spark, b.bin_table(data, FEATURES, edges=EDGES, partition_rows=size), members)
        fleet.run(1).run(14, [2])
        assert stored() - before == written and fleet.kept == [2] * written
        made.append((fleet.losses, [[[shape(t) for t in r] for r in m] for m in fleet.trees]))
        fleet.close()
    assert made[0] == made[1] and [len(x) for x in made[0][0]] == [1, 1, 14]


def test_a_few_hundred_thousand_rows_need_no_shuffle_a_wave(spark, monkeypatch):
    fields = [F.col("id"), F.pmod("id", F.lit(5)).cast("int").alias("fold"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("double").alias("x"), F.pmod("id", F.lit(7)).cast("double").alias("z")]
    y = F.pmod(F.floor(F.col("x") / 30) + F.when(F.col("z") == 3, 1).otherwise(0), F.lit(3))
    large = spark.range(0, 300_000, 1, 4).select(*fields).withColumns({w: (y == c).cast("int") for c, w in enumerate(WINNERS)})
    monkeypatch.setattr(b.Fleet, "_wave", None)
    table = b.bin_table(large, ("x", "z"))
    assert table.parts == 1
    fleet = b.Fleet(spark, table, [b.Member("m", 2, replace(DEPTHWISE, learning_rate=0.5))]).run(3)
    assert spark.read.parquet(table.path).agg(F.sum("n")).first()[0] == 300_000
    assert fleet.trees[0][0][0].n[0] == 240_000 and fleet.losses[0][-1] < fleet.losses[0][0] < 0.8
    fleet.close()


def test_patience_stops_a_fit_and_saved_models_end_at_the_best_round(spark, data):
    """Labels of noise: the held-out loss soon rises."""
    noise = data.withColumns({w: (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) == c).cast("int") for c, w in enumerate(WINNERS)})
    table = b.bin_table(noise, FEATURES)
    fleet = b.Fleet(spark, table, b.fold_members({"m": replace(DEPTHWISE, max_depth=5)}), patience=5).run(1000)
    assert all(fleet.stopped) and fleet.rounds < 200
    for m in range(5):
        losses = fleet.losses[m]
        best = min(range(len(losses)), key=losses.__getitem__)
        assert len(losses) == best + 1 + 5 == len(fleet.trees[m]) and fleet.best(m) == best + 1
    kept = {r["fold"]: r["n"] for r in fleet.nodes().groupBy("fold").agg(F.max("round").alias("n")).collect()}
    assert kept == {m: fleet.best(m) for m in range(5)}
    fleet.close()


def test_saved_models_score_their_own_fold(spark, data):
    odd = data.withColumns({w: F.when(F.col("id") != 7, F.col(w)) for w in WINNERS}).withColumn("fold", F.when(F.col("id") == 8, 9).when(F.col("id") != 9, F.col("fold")))
    table = b.bin_table(odd, FEATURES)
    assert sum(map(sum, table.counts)) == 497  # no label, no fold
    fleet = b.Fleet(spark, table, b.fold_members({"m": LEAFWISE})).run(6)
    scored = {r["id"]: [r[p] for p in PREDS] for r in b.predict(odd, fleet.nodes(), "m", FEATURES).collect()}
    assert len(scored) == 500 and scored[8] == scored[9] == [None] * 3
    assert all(abs(sum(v) - 1) < 1e-9 for k, v in scored.items() if k not in (8, 9))
    loss = defaultdict(list)
    for r in rows():
        if r[0] not in (7, 8, 9):
            loss[r[1]].append(-math.log(scored[r[0]][r[2:5].index(1)]))
    for m in range(5):
        assert np.mean(loss[m]) == pytest.approx(fleet.losses[m][fleet.best(m) - 1], abs=1e-6)
    fleet.close()


def test_gains_of_a_tree_made_by_hand(spark):
    fields = "model string, fold int, round int, class int, node int, feature string, threshold double, missing_left boolean, `left` int, `right` int, value double, gain double, n bigint"
    split = lambda f, at, node, name, gain: ("m", f, at, 0, node, name, 0.5, True, 1, 2, None, gain, 10)
    made = [split(0, 1, 0, "a", 4.0), split(0, 1, 1, "b", 1.0), split(0, 2, 0, "a", 2.0), split(1, 1, 0, "b", 3.0), ("m", 1, 1, 0, 1, None, None, None, None, None, 0.1, 0.0, 5)]
    models = spark.createDataFrame(made, fields)
    per_fold = {(r["fold"], r["feature"]): r["importance"] for r in b.gain_importance(models, ["a", "b", "c"]).collect()}
    assert per_fold == {(0, "a"): 6.0, (0, "b"): 1.0, (0, "c"): 0.0, (1, "a"): 0.0, (1, "b"): 3.0, (1, "c"): 0.0}
    mean = [(r["rank"], r["feature"], r["importance"]) for r in b.mean_gain(b.gain_importance(models, ["a", "b", "c"]), 2).collect()]
    assert sorted(mean) == [(1, "a", 3.0), (2, "b", 2.0)]
    skipped = [(r["rank"], r["feature"], r["importance"]) for r in b.mean_gain(b.gain_importance(models, ["a"], "skip")).collect()]
    assert sorted(skipped) == [(1, "a", 6.0), (2, "b", 2.0)]  # a mean over the folds that use it
    with pytest.raises(ValueError):
        b.gain_importance(models, ["a"], missing="drop")


def test_halving_promotes_the_better_trials(spark, data):
    table = b.bin_table(data, FEATURES)
    found = b.halving(spark, table, {n: b.SEARCH_SPACES[n] for n in ("leafwise", "depthwise")}, b.PRESETS, trials=4, rungs=(1, 3, 5), keep=0.5)
    got = found.collect()
    assert len(got) == 2 * (4 + 2 + 1)
    for name, space in b.SEARCH_SPACES.items():
        loss = {(r["rung"], r["trial"]): r["mean_log_loss"] for r in got if r["space"] == name}
        for rung, n in ((0, 2), (1, 1)):
            ups = [r for r in got if r["space"] == name and r["rung"] == rung and r["promoted"]]
            stay = [r["mean_log_loss"] for r in got if r["space"] == name and r["rung"] == rung and not r["promoted"]]
            assert len(ups) == n and max(r["mean_log_loss"] for r in ups) <= min(stay)
            assert all(loss[rung + 1, r["trial"]] <= r["mean_log_loss"] for r in ups)
        assert all(set(json.loads(r["parameters"])) == set(space) for r in got if r["space"] == name)
        assert set(b.best_trial(found, name)) == set(space)
    again = b.Fleet(spark, table, [b.Member("leafwise/1", f, b.Boost(**{**b.asdict(b.PRESETS["leafwise"]), **b.draw(b.SEARCH_SPACES["leafwise"], 4)[1]})) for f in range(5)]).run(1)
    first = next(r["mean_log_loss"] for r in got if (r["space"], r["rung"], r["trial"]) == ("leafwise", 0, 1))
    assert np.mean([x[0] for x in again.losses]) == pytest.approx(first, abs=1e-12)
    assert len(b.SEARCH_SPACES["leafwise"]) == 9 and len(b.SEARCH_SPACES["depthwise"]) == 7


def test_a_search_stores_no_margins_at_any_rung(spark, data, monkeypatch):
    """All trials would need their margins stored; only those promoted go on, from the trees they have."""
    shares, grow = [], b.Fleet._rounds

    def seen(self, active, n):
        shares.append((len(active), self.groups))
        grow(self, active, n)

    monkeypatch.setattr(b.Fleet, "_rounds", seen)
    monkeypatch.setattr(b.Fleet, "_refresh", None)
    found = b.halving(spark, b.bin_table(data, FEATURES), {"depthwise": b.SEARCH_SPACES["depthwise"]}, b.PRESETS, trials=6, rungs=(1, 2), keep=0.5).collect()
    assert len(found) == 9 and shares == [(30, 8), (15, 8)]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A folder with the one table that the stacking queries read."""
    at, words = str(tmp_path_factory.mktemp("tables")), ["red", "ox", "lantern", "of", "seventeen", "rivers", "a"]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, rng.integers(3, 40))) + "." for _ in range(150)]
    made = [(i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture
def fleets(monkeypatch):
    """The fleets closed during a test."""
    closed, close = [], b.Fleet.close
    monkeypatch.setattr(b.Fleet, "close", lambda self: (closed.append(self), close(self))[1])
    return closed


def whole(fleet, m):
    """Whether a model had 1,000 rounds or 50 without a better loss."""
    return len(fleet.losses[m]) == 1000 or len(fleet.losses[m]) - fleet.best(m) == 50


def test_the_registered_stack_grows_until_patience_ends_it(spark, documents, fleets):
    got = catalog.stack_oof(spark, documents).collect()
    assert len(got) == 2 * 150 and all(r["pred_a"] is not None for r in got)
    (fleet,) = fleets
    assert len(fleet.members) == 10 and all(whole(fleet, m) for m in range(10))
    assert max(map(len, fleet.losses)) > 120
    loss = {m.name: [] for m in fleet.members}
    known = {r["id"]: r for r in inputs.predictions(spark, documents).select("id", *WINNERS).collect()}
    for r in got:
        loss[r["variant"]].append(-math.log(r[PREDS[[known[r["id"]][w] for w in WINNERS].index(1)]]))
    for name, found in loss.items():
        best = [min(fleet.losses[i]) * fleet.held[i] for i, m in enumerate(fleet.members) if m.name == name]
        assert np.mean(found) == pytest.approx(sum(best) / 150, abs=1e-4)


def test_the_registered_search_ends_with_whole_fits(spark, documents, fleets):
    found = catalog.tune_stacker(spark, documents, trials=3).collect()
    (fleet,) = fleets
    assert sorted((r["space"], r["rung"]) for r in found) == sorted((s, k) for s in b.SEARCH_SPACES for k in (0, 0, 0, 1, 2, 3, 4))
    assert all(r["rounds"] == 10 for r in found if r["rung"] == 0) and max(r["rounds"] for r in found) > 27
    winners = {f"{r['space']}/{r['trial']}" for r in found if r["rung"] == 4}
    ended = [i for i, m in enumerate(fleet.members) if m.name in winners]
    assert len(ended) == 10 and all(whole(fleet, i) for i in ended)
    for r in found:
        if r["rung"] == 4:
            best = [min(fleet.losses[i]) for i in ended if fleet.members[i].name == f"{r['space']}/{r['trial']}"]
            assert r["mean_log_loss"] == pytest.approx(np.mean(best), abs=1e-6) and not r["promoted"]
    assert not any(fleet.trees)  # those of a trial are dropped once it ends


def test_the_registered_search_has_50_trials_a_space():
    default = {k: p.default for k, p in inspect.signature(catalog.tune_stacker).parameters.items()}
    assert default["trials"] == 50 and default["rungs"] == (10, 30, 90, 270, 1000)


def test_steps_bounded_by_nodes_give_the_same_trees(spark, data, monkeypatch):
    table, members, made = b.bin_table(data, FEATURES), [b.Member("l", 0, LEAFWISE), b.Member("d", 1, DEPTHWISE)], []
    steps, grow = [], b.Fleet._rounds
    monkeypatch.setattr(b.Fleet, "_rounds", lambda self, active, n: (steps.append(n), grow(self, active, n))[1])
    for most in (1 << 20, 1):
        monkeypatch.setattr(b, "STEP_NODES", most)
        fleet = b.Fleet(spark, table, members).run(30)
        made.append((fleet.losses, [[[shape(t) for t in r] for r in m] for m in fleet.trees]))
        fleet.close()
    assert made[0] == made[1] and steps == [30, 12, 12, 6]


def test_models_that_split_on_a_feature_the_rows_lack_are_refused(spark, data):
    fleet = b.Fleet(spark, b.bin_table(data, FEATURES), [b.Member("m", 0, LEAFWISE)]).run(2)
    with pytest.raises(ValueError, match="feature"):
        b.predict(data, fleet.nodes(), "m", FEATURES[:1])
    fleet.close()


def wide_rows(widths, n=6000):
    rng = np.random.default_rng(8)
    columns = np.stack([rng.integers(0, w, n).astype(np.uint8) for w in widths])
    label = ((columns[0] > 30).astype(int) + (columns[3] == 1) + (rng.random(n) < 0.2)).astype(np.int8) % 3
    rows = {"row": rng.integers(-(1 << 62), 1 << 62, n), "fold": rng.integers(0, 5, n).astype(np.int8), "label": label, "columns": columns}
    return rows, rng


def test_features_counted_together_give_the_sums_of_each(spark):
    """37 features as wide as those of the registered search take a third of the passes over the rows."""
    widths = [64] * 9 + [3] * 12 + [64] * 7 + [46, 45, 47] + [4] * 6
    made = b.joints(widths)
    assert sorted(f for j in made for f in j.features) == list(range(37)) and len(made) <= 13
    assert all(np.prod(j.widths) <= b.JOINT_BINS for j in made) and [j.features for j in b.joints([300, 5000, 2])] == [(1,), (0, 2)]
    rows, rng = wide_rows(widths, 40_000)
    keys = b._joined(rows["columns"], widths)
    p, cols = rng.random(40_000), np.array([0, 3, 4, 20, 28, 30, 33])
    hit = rows["label"] == 1
    g, h = b.class_gradients(p, hit, 1.5)
    for some in (None, np.flatnonzero(p < 0.7)):
        plain = b._sums(rows["columns"], some, None, 1, g, h, cols, 64)[:, 0]
        assert (b._joint_sums(made, keys, some, g, h, cols, 64, None) == plain).all()
    g, h = b.class_gradients(np.full(40_000, 0.3), hit, 1.5)
    for some in (None, np.flatnonzero(p < 0.7)):  # before the first tree counts say all
        plain = b._sums(rows["columns"], some, None, 1, g, h, cols, 64)[:, 0]
        assert (b._joint_sums(made, keys, some, g, h, cols, 64, b.Flat.of(g, h, hit)) == plain).all()


@pytest.mark.parametrize("params", [LEAFWISE, replace(DEPTHWISE, bagging_fraction=0.7)])
def test_models_grown_by_joint_keys_are_the_same(spark, monkeypatch, params):
    widths = [64, 3, 46, 3, 4]
    rows, _ = wide_rows(widths)
    rows["joint"] = b._joined(rows["columns"], widths)
    found = []
    for least in (1, 1 << 10, 1 << 30):  # by joint keys, both, by feature
        monkeypatch.setattr(b, "JOINT_ROWS", least)
        found.append(b._grow_model(b.Member("m", 1, params), rows, np.log([0.3, 0.4, 0.3]), [], [], range(4), 42, 50, 5, widths))
    assert len({repr([[[shape(t) for t in trees], loss] for trees, loss in out]) for out in found}) == 1
    assert len(found[0]) == 4 and found[0][-1][1] < found[0][0][1]


def test_encoding_uses_other_folds_only(spark):
    made = [(i, i % 4 if i % 9 else None, [None, "a", "b", f"rare{i}"][i % 4 if i < 60 else 1], i % 3 if i % 10 else None) for i in range(120)]  # a third and more of one value
    table = [(i, f, c, *[int(y == k) if y is not None else None for k in range(3)]) for i, f, c, y in made]
    df = spark.createDataFrame(table, "id long, fold int, cluster string, winner_model_a int, winner_model_b int, winner_tie int")
    got = {r["id"]: r for r in fold_encoding(df, ["cluster"], smoothing=5.0).collect()}
    assert len(got) == 120 and "cluster" not in next(iter(got.values())).asDict()
    for i, f, c, _ in made:
        other = [(c2, y) for _, f2, c2, y in made if y is not None and (f is None or f2 != f)]
        same = [y for c2, y in other if c2 == c]
        for k, s in enumerate(("a", "b", "tie")):
            prior = sum(y == k for _, y in other) / len(other)
            assert got[i][f"cluster__{s}"] == pytest.approx((same.count(k) + 5 * prior) / (len(same) + 5))

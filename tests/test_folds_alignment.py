import pytest
from pyspark.sql import functions as F

from pairwright.operators import alignment, folds, hot_keys


def skewed(spark, n=3000, parts=3):
    """A third of all rows in one stratum, the rest in many."""
    s = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 97).cast("string")))
    return spark.range(n, numPartitions=parts).withColumn("s", s)


def assigned(df, **options):
    return {r["id"]: r["fold"] for r in folds.assign_folds(df, F.col("s"), **options).select("id", "fold").collect()}


def test_folds_are_balanced_overall_and_per_stratum(spark):
    df = folds.assign_folds(skewed(spark), F.col("s"), keep_stratum="g")
    sizes = [r["n"] for r in folds.fold_counts(df).collect()]
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) <= 1
    assert max(r["spread"] for r in folds.fold_balance(df, "g").collect()) <= 1


def test_folds_do_not_depend_on_layout_or_buckets(spark):
    base = assigned(skewed(spark))
    assert assigned(skewed(spark, parts=11).orderBy(F.desc("id"))) == base
    assert assigned(skewed(spark), bucket_digits=1) == base
    assert assigned(skewed(spark), bucket_digits=5) == base
    assert assigned(skewed(spark), seed=7) != base


def test_small_strata_and_missing_strata(spark):
    df = spark.createDataFrame([(i, None if i < 2 else "x") for i in range(7)], "id long, s string")
    got = assigned(df, k=5)
    assert len(got) == 7 and set(got.values()) == {0, 1, 2, 3, 4}


def test_splits_cover_all_rows(spark):
    df = folds.assign_folds(skewed(spark, 500), F.col("s"))
    for row in folds.split_counts(df).collect():
        assert row["n_train"] + row["n_valid"] == 500
        assert folds.train_rows(df, row["fold"]).count() == row["n_train"]
        assert folds.valid_rows(df, row["fold"]).count() == row["n_valid"]


PRED = "id long, pred_a double, pred_b double, pred_tie double"


def test_alignment_is_by_key(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    shuffled = spark.createDataFrame([(3, 0.3, 0.3, 0.4), (1, 0.1, 0.1, 0.8)], PRED)
    rows = {r["id"]: r["m_a"] for r in alignment.align_models(base, {"m": shuffled}).collect()}
    assert rows == {1: 0.1, 3: 0.3}
    left = {r["id"]: r["m_a"] for r in alignment.align_models(base, {"m": shuffled}, how="left").collect()}
    assert left == {1: 0.1, 2: None, 3: 0.3}


def test_audit_finds_everything(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    right = spark.createDataFrame([(2,), (3,), (3,), (3,), (9,)], "id long")
    assert alignment.alignment_audit(left, right).first().asDict() == {
        "left_rows": 4, "right_rows": 5, "matched_keys": 2, "left_only_keys": 1, "right_only_keys": 1, "left_repeated_keys": 1, "right_repeated_keys": 1,
    }
    with pytest.raises(ValueError):
        alignment.require_aligned(left, right)
    alignment.require_aligned(left.distinct(), spark.range(1, 4))


def test_backfill_leaves_present_columns(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id long, x int")
    labels = spark.createDataFrame([(1, 50, 7)], "id long, x int, y int")
    assert alignment.backfill(df, labels, ["x"]) is df
    assert {r["id"]: (r["x"], r["y"]) for r in alignment.backfill(df, labels, ["x", "y"]).collect()} == {1: (5, 7), 2: (6, None)}


def test_completeness_reports_empty_folds(spark):
    base = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, fold int")
    oof = spark.createDataFrame([(1,), (2,), (2,), (3,), (77,)], "id long")
    rows = {r["fold"]: r for r in alignment.oof_completeness(base, oof, k=3).collect()}
    assert (rows[0]["n_scored"], rows[0]["n_repeated"], rows[0]["complete"]) == (1, 1, False)
    assert rows[1]["complete"] and not rows[2]["complete"] and rows[2]["n_rows"] == 0


def test_union_needs_every_fold(spark):
    part = spark.createDataFrame([(1,)], "id long")
    assert alignment.union_folds({0: part, 1: part}, k=2).count() == 2
    with pytest.raises(ValueError):
        alignment.union_folds({0: part}, k=2)


def test_row_counts(spark):
    got = alignment.row_counts({"a": spark.range(3), "b": spark.range(5)}, expected=3).collect()
    assert {r["source"]: (r["n_rows"], r["as_expected"]) for r in got} == {"a": (3, True), "b": (5, False)}


def test_select_like_model(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, b int, a int")
    assert alignment.select_like_model(df, ["a", "b"]).columns == ["id", "a", "b"]


def joined_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("side", ["left", "right", "both", "none"])
def test_hot_joins_equal_plain_joins(spark, how, side):
    """A third and more of the rows on one key; keys of one side only, repeated and NULL keys."""
    left = [(k, f"l{k}") for k in range(60)] + [(None, "null"), (3, "again")]
    right = [(k, k * 1.5) for k in range(30, 90)] + [(None, 0.5), (41, -1.0), (1000, 7.0)]
    left += [(1000 if side != "right" else 40, f"h{k}") for k in range(400 if side in ("left", "both") else 2)]
    right += [(1000, float(k)) for k in range(300 if side in ("right", "both") else 1)]
    if side == "right":
        left += [(1000, "once"), (1000, "once")]
    a = spark.createDataFrame(left, "id long, name string").repartition(4)
    b = spark.createDataFrame(right, "id long, value double").repartition(3)
    got = hot_keys.hot_join(a, b, "id", how)
    assert got.columns == ["id", "name", "value"] and joined_rows(got) == joined_rows(a.join(b, "id", how))


def test_hot_keys_are_found_and_spread(spark):
    rows = spark.range(30_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit(1).alias("x"))
    found = hot_keys.hot_keys(rows, "id", 0.01)
    assert list(found) == [-1] and found[-1] >= 10_000
    other = spark.range(30_000).select("id", F.lit(2).alias("y")).unionByName(spark.createDataFrame([(-1, 5)], "id long, y int"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = hot_keys.hot_join(rows, other, "id")
        sizes = sorted(r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 30_000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    with pytest.raises(ValueError):
        hot_keys.hot_join(rows, other, "id", "outer")


def test_strict_alignment_refuses_to_shrink(spark):
    base = spark.createDataFrame([(1,), (2,)], "id long")
    preds = spark.createDataFrame([(1, 0.2, 0.3, 0.5)], "id long, pred_a double, pred_b double, pred_tie double")
    assert alignment.align_models(base, {"m": preds}).count() == 1
    with pytest.raises(ValueError, match="left_only_keys"):
        alignment.align_models(base, {"m": preds}, strict=True)

"""Streaming end states, and the shape of physical plans."""

import datetime
import glob
import re

import pytest

from __spark_entry__ import queries
from pairwright.operators import curves, metrics
from pairwright.plans import inputs
from pairwright.session import shared_root
from pairwright.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_a_repeated_file_counts_once(spark, tmp_path):
    landed = inputs.folded(spark, SF).drop("stratify_group")
    landed.filter("fold < 3").write.parquet(str(tmp_path / "in" / "one"))
    landed.filter("fold >= 2").write.parquet(str(tmp_path / "in" / "two"))
    stream = jobs.stream_fold_metrics(spark, str(tmp_path / "in" / "*"), landed.schema, inputs.MODELS)
    got = jobs.run_available(stream, "t", str(tmp_path / "out"), str(tmp_path / "ck"))
    want = metrics.model_metrics(landed, inputs.MODELS, ["fold"])
    key = ("fold", "model", "n")
    assert sorted(tuple(r[c] for c in key) for r in got.collect()) == sorted(tuple(r[c] for c in key) for r in want.collect())


def test_hours_of_the_late_stream_are_written_by_several_tasks(spark):
    """No task holds the rows of a whole hour; what is counted is unchanged."""
    root = f"{shared_root(spark).removeprefix('file:')}/pairwright"
    before = set(glob.glob(f"{root}/landed-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries()["stream_fold_metrics_late"](spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (landed,) = set(glob.glob(f"{root}/landed-*")) - before
    assert all(len(glob.glob(f"{landed}/hour={h}/*.parquet")) > 1 for h in range(4))
    want = metrics.model_metrics(inputs.folded(spark, SF), inputs.MODELS, ["fold"]).collect()
    assert sorted((r["fold"], r["model"], r["n"]) for r in got) == sorted((r["fold"], r["model"], r["n"]) for r in want)
    assert {r["n_late"] for r in got} == {inputs.table(spark, SF, "documents").where("doc_id % 100 = 0").count()}


def test_state_shrinks_behind_the_watermark(spark, tmp_path):
    """Six hours of files, each repeating some keys of the hour before; a late row; keys leave the state after 90 minutes."""
    fields = "id long, fold int, landed timestamp, winner_model_a int, winner_model_b int, winner_tie int, a double, b double, t double"
    for h in range(6):
        mine = [(100 * h + k, k % 5) for k in range(100)] + [(100 * (h - 1) + k, k % 5) for k in range(0, 30 if h else 0)]
        rows = [(i, f, datetime.datetime(2024, 1, 1, h), 1, 0, 0, 0.5, 0.3, 0.2) for i, f in mine]
        rows += [(9999, 0, datetime.datetime(2023, 1, 1), 0, 1, 0, 0.5, 0.3, 0.2)] * (h == 5)
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / "in" / f"h{h}"))
    progress = []
    stream = jobs.stream_fold_metrics_late(spark, str(tmp_path / "in" / "*"), fields, {"m": ("a", "b", "t")}, "landed", "90 minutes", files=1)
    got = jobs.run_available(stream, "late", str(tmp_path / "out"), str(tmp_path / "ck"), progress).collect()
    assert sorted((r["fold"], r["n"]) for r in got) == [(f, 120) for f in range(5)]  # each of the 600 keys once, without the late one
    report = [r for r in jobs.state_report(spark, progress).orderBy("batch").collect() if r["operator"].startswith("dedup")]
    assert sum(r["late_rows"] for r in report) == 1
    held = [r["state_rows"] for r in report]
    assert max(held) < 600 and held[-1] < max(held)


def test_a_stream_continues_where_it_stopped(spark, tmp_path):
    source, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    lines = [r["value"] for r in inputs.log_lines(spark, SF).orderBy("event_id").collect()]

    def run():
        return jobs.run_available(jobs.stream_log_curves(spark, str(source)), "logs", out, checkpoint)

    (source / "M1_Fold0.log").write_text("\n".join(lines[:400]))
    run()
    (source / "M2_Fold0.log").write_text("\n".join(lines[400:]))
    got = run()
    batch = curves.curve_by_type(curves.parse_logs(spark.createDataFrame([("M1_a" if i < 400 else "M2_a", v) for i, v in enumerate(lines)], "run string, value string")))

    def rows(df):
        return sorted((r["kind"], r["model_type"], r["epoch"], r["n"], round(r["mean_loss"], 9), round(r["sd_loss"], 9)) for r in df.collect())

    assert rows(got) == rows(batch)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ["model_metrics", "sample_loss", "class_labels", "cluster_loss", "confusion_matrix", "class_report", "bad_cases", "stratified_folds", "fold_metrics", "align_models", "alignment_audit", "ensemble_grid", "blend_metrics", "confidence_density", "distill_loss"]


@pytest.mark.parametrize("name", NARROW)
def test_metric_plans_never_read_texts(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(queries()[name](spark, SF)))
    assert schemas and all("text" not in s for s in schemas)


@pytest.mark.parametrize("name", [*NARROW, "dpo_pairs", "render_prompt", "truncation_report", "conflict_cases", "clean_features", "sample_pairs", "label_backfill", "teacher_join", "log_curves"])
def test_plans_have_no_cross_join(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["bad_cases", "sample_pairs", "conflict_sample"])
def test_top_rows_are_taken_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(queries()[name](spark, SF))


def test_folds_gather_only_group_totals(spark):
    """The one single-partition step sums at most 4,096 group totals."""
    text = plan(inputs.folded(spark, SF))
    assert text.count("Exchange SinglePartition") == 1
    below = text[text.index("Exchange SinglePartition") :].splitlines()[1]
    assert "HashAggregate(keys=[_group#" in below


def test_samples_reduce_every_side_before_joining(spark):
    text = plan(queries()["sample_pairs"](spark, SF))
    assert text.count("LeftSemi") >= 3


def test_metrics_shuffle_once(spark):
    assert plan(queries()["model_metrics"](spark, SF)).count("Exchange") == 1
    assert plan(metrics.model_metrics(inputs.predictions(spark, SF), inputs.MODELS, ["cluster_id_k20"])).count("Exchange") == 1


@pytest.mark.parametrize("name", ["render_prompt", "dpo_pairs"])
def test_rendering_adds_no_shuffle(spark, name):
    assert plan(queries()[name](spark, SF)).count("Exchange hashpartitioning") <= plan(inputs.pairs(spark, SF)).count("Exchange hashpartitioning")

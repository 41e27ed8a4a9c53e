"""Loss curves and checkpoints from training logs. The same functions serve batch and streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.records import basename, checkpoint_step, log_record, model_type, record_kind, record_loss


def parse_logs(lines: DataFrame, value: str = "value", run: str = "run") -> DataFrame:
    """(run, model_type, kind, epoch, loss) from log lines; lines without a readable record are skipped."""
    # inline makes the record's fields columns of their own, so each line is parsed once however often they are used
    parsed = lines.select(run, F.inline(F.array(log_record(value))))
    return parsed.select(
        run, model_type(run).alias("model_type"), record_kind().alias("kind"), "epoch", record_loss().alias("loss")
    ).filter(F.col("kind").isNotNull())


def curve_by_type(records: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the loss per model type and epoch, training and evaluation apart."""
    return records.groupBy("kind", "model_type", "epoch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"), F.stddev("loss").alias("sd_loss")
    )


def curve_by_run(records: DataFrame, run: str = "run") -> DataFrame:
    """One line per run; several records of one epoch are averaged."""
    return records.groupBy("kind", run, "epoch").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"))


def best_checkpoint(evals: DataFrame, metric: str = "loss", checkpoint: str = "checkpoint", run: str = "run") -> DataFrame:
    """The checkpoint with the lowest metric per run; the earlier one when two are equal."""
    order = F.struct(F.col(metric), checkpoint_step(checkpoint), F.col(checkpoint))
    return evals.groupBy(run).agg(
        F.min_by(checkpoint, order).alias("best_model_checkpoint"), F.min(metric).alias("best_metric")
    )


def latest_checkpoint(paths: DataFrame, path: str = "path", run: str = "run") -> DataFrame:
    """The path with the highest step per run, by number and not by text."""
    order = F.struct(checkpoint_step(path), F.col(path))
    return paths.groupBy(run).agg(F.max_by(path, order).alias("latest_checkpoint"), F.max(checkpoint_step(path)).alias("step"))


def resolve_checkpoint(states: DataFrame, paths: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """Per run: the checkpoint its state document names, as long as that checkpoint exists, else the latest one.

    Both sides are one row per run after aggregation.
    """
    existing = paths.select(run, basename(path).alias("_name"), F.col(path).alias("_path"))
    named = states.select(run, basename("best_model_checkpoint").alias("_name"))
    best = named.join(existing, [run, "_name"]).groupBy(run).agg(F.max("_path").alias("_best"))
    latest = latest_checkpoint(paths, path, run)
    return latest.join(best, run, "left").select(
        run,
        F.coalesce("_best", "latest_checkpoint").alias("checkpoint"),
        F.when(F.col("_best").isNotNull(), "best").otherwise("latest").alias("chosen_by"),
    )

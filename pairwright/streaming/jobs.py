"""Streaming forms of the loss curves and of the per-fold metrics.

Both keep small aggregates as state and publish the whole result after every batch (complete mode).
On a cluster use the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps
the de-duplication state of :func:`stream_fold_metrics` on disk.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.operators.curves import curve_by_type, parse_logs
from pairwright.operators.metrics import Models, model_metrics
from pairwright.schema import FOLD, ID
from pairwright.session import new_path
from pairwright.sources.readers import read_logs


def stream_log_curves(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)\.log$") -> DataFrame:
    """Loss curves over log files that are still growing in number."""
    return curve_by_type(parse_logs(read_logs(spark, path, run_pattern, streaming=True)))


def stream_fold_metrics(
    spark: SparkSession, path: str, schema: StructType | str, models: Models, key: str = ID, fold: str = FOLD
) -> DataFrame:
    """Per-fold metrics over prediction files as they land.

    A key that arrives twice, for instance from a restarted scoring job, counts once. The keys seen are
    kept as state, so it grows with the rows of one evaluation run; start a new query for a new run.
    """
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)
    return model_metrics(arrived.dropDuplicates([key]), models, [fold])


def stream_fold_metrics_late(
    spark: SparkSession, path: str, schema: StructType | str, models: Models, landed: str, delay: str, key: str = ID, fold: str = FOLD, files: int = 1000
) -> DataFrame:
    """Per-fold metrics whose state stays bounded: a key that arrives again within ``delay`` of its first landing time counts once.

    Keys are forgotten once the watermark, ``delay`` behind the latest ``landed``, has passed them by ``delay``; rows that land behind the watermark are left
    out. :func:`state_report` tells how many were, and how many keys were held.
    """
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    fresh = arrived.withWatermark(landed, delay).dropDuplicatesWithinWatermark([key])
    return model_metrics(fresh, models, [fold])


def state_report(spark: SparkSession, progress: Sequence[dict]) -> DataFrame:
    """``(batch, operator, state_rows, late_rows)`` of the batches of a query, from its progress records."""
    rows = [
        (p["batchId"], o["operatorName"], o["numRowsTotal"], o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"]
    ]
    return spark.createDataFrame(rows, "batch long, operator string, state_rows long, late_rows long")


def run_available(stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None, progress: list | None = None) -> DataFrame:
    """Process everything that has arrived, stop, and return the last published result.

    Each batch is written under its number, so a batch repeated after a failure replaces itself. The progress records of the run, of its last
    ``spark.sql.streaming.numRecentProgressUpdates`` batches, are added to ``progress``.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, f"{label}-result")
    checkpoint = checkpoint or new_path(spark, f"{label}-checkpoint")

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
    query.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) for p in query.recentProgress]
    published = spark.read.parquet(out)
    newest = published.agg(F.max("batch")).scalar()
    return published.filter(F.col("batch") == newest).drop("batch")

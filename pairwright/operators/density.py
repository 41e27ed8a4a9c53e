"""Gaussian kernel density of a predicted probability, per model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.rows import unpivot

#: Bins over [0, 1]. A bin is represented by the mean of its members, so the error of the curve is of
#: second order in (bin width / bandwidth).
BINS = 10_000


def confidence_density(
    df: DataFrame, columns: Mapping[str, str], points: int = 200, cut: float = 3.0, bins: int = BINS
) -> DataFrame:
    """(model, point, x, density) on an even grid that reaches ``cut`` bandwidths past the data.

    The bandwidth is Scott's rule, sd * n ** (-1/5). Rows are first counted into at most ``bins + 1``
    bins per model, combined before the shuffle; the kernel is evaluated on bins, never on rows.
    """
    values = unpivot(df, [], [{"model": F.lit(m), "p": F.col(c)} for m, c in columns.items()])
    values = values.filter(F.col("p").isNotNull() & ~F.isnan("p"))
    binned = values.groupBy("model", F.floor(F.col("p") * bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p").alias("s"),
        F.sum(F.col("p") * F.col("p")).alias("ss"),
        F.min("p").alias("lo"),
        F.max("p").alias("hi"),
    )
    totals = binned.groupBy("model").agg(
        F.sum("n").alias("n_all"),
        F.sum("s").alias("s_all"),
        F.sum("ss").alias("ss_all"),
        F.min("lo").alias("lo_all"),
        F.max("hi").alias("hi_all"),
    )
    variance = (F.col("ss_all") - F.col("s_all") * F.col("s_all") / F.col("n_all")) / (F.col("n_all") - 1)
    bandwidth = F.sqrt(variance) * F.pow(F.col("n_all").cast("double"), F.lit(-0.2))
    # one row per model
    shape = totals.filter((F.col("n_all") > 1) & (F.col("hi_all") > F.col("lo_all"))).select(
        "model",
        "n_all",
        bandwidth.alias("bw"),
        (F.col("lo_all") - cut * bandwidth).alias("x0"),
        (F.col("hi_all") + cut * bandwidth).alias("x1"),
    )
    step = (F.col("x1") - F.col("x0")) / F.lit(float(points - 1))
    grid = (
        binned.select("model", "n", (F.col("s") / F.col("n")).alias("centre"))
        .join(F.broadcast(shape), "model")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .withColumn("x", F.col("x0") + step * F.col("point"))
    )
    z = (F.col("x") - F.col("centre")) / F.col("bw")
    kernel = F.col("n") * F.exp(-0.5 * z * z)
    norm = F.first("n_all") * F.first("bw") * F.sqrt(2 * F.pi())
    return grid.groupBy("model", "point").agg(F.first("x").alias("x"), (F.sum(kernel) / norm).alias("density"))

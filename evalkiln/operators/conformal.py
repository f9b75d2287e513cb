"""Split-conformal intervals with exact ranks and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalkiln.functions.scalars import conformal_rank, interval
from evalkiln.operators import order


def coverages(spark, values: tuple[float, ...]) -> DataFrame:
    """The coverages as a table: in (0, 1) and strictly rising."""
    if not all(0 < v < 1 for v in values) or list(values) != sorted(set(values)):
        raise ValueError("coverages have to rise strictly within (0, 1)")
    return spark.createDataFrame([(v,) for v in values], "coverage double")


def quantiles(residuals: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """(keys, coverage, rank, radius): the order statistic at the exact rank; null radius where the rank exceeds n.

    ``residuals`` has the keys and ``residual``. The value of a rank is selected by ranges (``order_statistics``), so a
    target with any number of residuals is never sorted in one task.
    """
    keys = list(keys)
    sizes = residuals.groupBy(*keys).agg(F.count("*").alias("n"))
    ranks = sizes.crossJoin(F.broadcast(wanted)).select(*keys, "coverage", conformal_rank(F.col("n"), F.col("coverage")).alias("rank"))  # a few coverages
    return order.order_statistics(residuals, "residual", ranks, keys, name="radius")


def joint_max(residuals: DataFrame) -> DataFrame:
    """One residual per unit, the largest over its targets."""
    return residuals.groupBy("sample_id").agg(F.max("residual").alias("residual")).withColumn("target", F.lit("*"))


def apply(predictions: DataFrame, radii: DataFrame) -> DataFrame:
    """Predictions with (coverage, lower, upper), one row per coverage; null ends where the radius is unbounded."""
    joined = predictions.join(F.broadcast(radii), "target")  # one radius per target and coverage
    lower, upper = interval(F.col("value"), F.col("radius"))
    return joined.withColumn("lower", lower).withColumn("upper", upper)


def metrics(intervals: DataFrame, keys: tuple[str, ...] = ("coverage",)) -> DataFrame:
    """Empirical coverage, its gap, mean and median width and the Winkler score.

    Widths and score are null where any interval of the group is unbounded: a mean of the bounded ones would flatter.
    """
    miss = F.when(F.col("y") < F.col("lower"), F.col("lower") - F.col("y")).when(F.col("y") > F.col("upper"), F.col("y") - F.col("upper")).otherwise(0.0)
    width = F.col("upper") - F.col("lower")
    inside = F.when(F.col("lower").isNull(), 1.0).when((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper")), 1.0).otherwise(0.0)
    bounded = lambda c: F.when(F.count_if(width.isNull()) == 0, c)
    out = intervals.groupBy(*dict.fromkeys([*keys, "coverage"])).agg(
        F.count("*").alias("n"), F.avg(inside).alias("empirical"), bounded(F.avg(width)).alias("mean_width"), bounded(F.median(width)).alias("median_width"),
        bounded(F.avg(width + 2.0 / (1 - F.col("coverage")) * miss)).alias("winkler"),
    )
    return out.withColumn("gap", F.col("empirical") - F.col("coverage"))


def cohort_overlap(calibration: DataFrame, training: DataFrame) -> DataFrame:
    """Calibration samples that training has touched."""
    return calibration.select("sample_id").distinct().join(training, "sample_id", "left_semi")



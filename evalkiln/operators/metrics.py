"""Metrics of predictions against the truth, all in one aggregation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LOWER_IS_BETTER = {"mse": True, "rmse": True, "mae": True, "r2": False, "accuracy": False, "balanced_accuracy": False}


def score_join(predictions: DataFrame, truth: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Predictions with y by unit id, and the keys that only one side has (side, keys)."""
    joined = predictions.join(truth, keys)
    lone = predictions.join(truth, keys, "left_anti").select(F.lit("prediction").alias("side"), *keys)
    return joined, lone.union(truth.join(predictions, keys, "left_anti").select(F.lit("truth").alias("side"), *keys))


def regression_aggs(p: str = "value", y: str = "y") -> dict[str, Column]:
    """MSE, RMSE, MAE and R², all in one pass; R² of a constant truth is 1 if every prediction is exact, else 0."""
    e = F.col(p) - F.col(y)
    residual, total = F.sum(e * e), F.var_pop(y) * F.count(y)  # the variance is merged from parts without losing digits
    return {
        "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)),
        "r2": F.when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - residual / F.nullif(total, F.lit(0.0))),
    }


def report(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("mse", "rmse", "mae", "r2")) -> DataFrame:
    """One row per key with the metrics: one aggregation."""
    aggs = regression_aggs()
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[aggs[m].alias(m) for m in metrics])


def long_form(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value)."""
    return wide.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")


def across_targets(per_target: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The mean over targets of each target's metric; RMSE is not pooled."""
    return per_target.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cross-fold rows: repeats of a sample are averaged first, then all folds are one set."""
    return rows.groupBy(*keys, "sample_id", "y").agg(F.avg("value").alias("value"))


def same_class(p: Column, y: Column) -> Column:
    return F.abs(p - y) < 0.5


def accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(same_class(F.col("value"), F.col("y")).cast("double")).alias("accuracy"))


def balanced_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The unweighted mean of the recalls of the classes of y."""
    per = rows.withColumn("class", F.round("y")).groupBy(*keys, "class").agg(F.avg(same_class(F.col("value"), F.col("y")).cast("double")).alias("recall"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_classes"), F.avg("recall").alias("balanced_accuracy"))


def reduce_scores(scores: DataFrame, keys: list[str], how: str, weight: str = "n") -> DataFrame:
    """mean, sum or weighted_mean of a value over components."""
    agg = {"mean": F.avg("value"), "sum": F.sum("value"), "weighted_mean": F.sum(F.col("value") * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))}[how]
    return scores.groupBy(*keys).agg(agg.alias("value"))


def losses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared error and binary cross entropy of probabilities p of a 0/1 truth."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("y")
    return rows.groupBy(*keys).agg(F.avg((F.col("p") - y) * (F.col("p") - y)).alias("mse"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("bce"))


def custom_metric(rows: DataFrame, keys: list[str], fn: Callable[[pd.Series, pd.Series], float]) -> DataFrame:
    """A metric in Python as a grouped-aggregate pandas UDF; a group has to fit in a task."""

    def evaluate(p: pd.Series, y: pd.Series) -> float:
        return float(fn(p, y))

    return rows.groupBy(*keys).agg(F.pandas_udf(evaluate, "double")("value", "y").alias("value"))


def score_violations(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a set of scores has more than once."""
    return scores.groupBy(*keys).count().where("count > 1").drop("count")


def residual_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their absolute residual and its rank within the keys."""
    r = rows.withColumn("residual", F.abs(F.col("value") - F.col("y")))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("residual", "sample_id")))

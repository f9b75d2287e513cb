"""Scores of processing chains, made comparable across datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalkiln.functions.scalars import oriented
from evalkiln.operators import order


def percentile_rank(df: DataFrame, dataset: str, score: str, name: str = "percentile") -> DataFrame:
    """Rank in [0, 1] within a dataset; ties share the mean of their ranks, a lone score has 0.5.

    Scores are counted by value and the counts added up by ranges, so a dataset of any size is spread over tasks; null
    scores rank below all others.
    """
    ranks = order.rank_of_values(df, score, [dataset])
    n = df.groupBy(F.col(dataset).alias("__d")).agg(F.count("*").alias("__n"))
    placed = ranks.join(n, F.col(dataset).eqNullSafe(F.col("__d"))).select(
        "__d", F.col(score).alias("__s_"), F.when(F.col("__n") == 1, 0.5).otherwise((F.col("before") + (F.col("ties") - 1) / 2.0) / F.nullif(F.col("__n") - 1, F.lit(0))).alias(name)
    )
    return df.join(placed, F.col(dataset).eqNullSafe(F.col("__d")) & F.col(score).eqNullSafe(F.col("__s_"))).drop("__d", "__s_")


def z_score(df: DataFrame, dataset: str, score: str, name: str = "z") -> DataFrame:
    """Distance from the mean in sample deviations; 0 for fewer than two scores or a constant one. One small join."""
    stats = df.groupBy(dataset).agg(F.avg(score).alias("__mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("__sd"))
    z = F.when(F.col("__sd") > 0, (F.col(score) - F.col("__mean")) / F.nullif("__sd", F.lit(0.0))).otherwise(0.0)
    return df.join(stats, dataset).withColumn(name, z).drop("__mean", "__sd")


def chain_effect(observations: DataFrame, lens: str, lower_is_better: bool) -> DataFrame:
    """Observations with goodness (higher is better) under a lens: raw, rank_by_dataset or z_by_dataset."""
    rows = observations.withColumn("__s", oriented(F.col("score"), lower_is_better))
    if lens == "rank_by_dataset":
        rows = percentile_rank(rows, "dataset", "__s", "goodness")
    elif lens == "z_by_dataset":
        rows = z_score(rows, "dataset", "__s", "goodness")
    else:
        rows = rows.withColumn("goodness", F.col("__s"))
    return rows.drop("__s")


def baseline(chains: DataFrame) -> DataFrame:
    """The median goodness of all chains."""
    return chains.where(~F.isnan("goodness")).agg(F.median("goodness").alias("baseline"), F.count("*").alias("n"))


def step_effects(chains: DataFrame) -> DataFrame:
    """(token, role, n, effect): the mean goodness of the chains that have a step, minus the baseline."""
    base = baseline(chains).select("baseline")
    steps = chains.select("id", "goodness", F.explode("steps").alias("s")).select("id", "goodness", "s.token", "s.role").distinct()
    return steps.groupBy("token", "role").agg(F.count("*").alias("n"), F.avg("goodness").alias("g")).crossJoin(F.broadcast(base)).select("token", "role", "n", (F.col("g") - F.col("baseline")).alias("effect"))

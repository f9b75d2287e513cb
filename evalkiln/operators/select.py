"""Ranking and selection of candidates and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """(candidate_id, problem): scores that are missing or not finite, and repeated candidates."""
    bad = candidates.where(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).select("candidate_id", F.lit("not_finite").alias("problem"))
    keys = [c for c in ("candidate_id", "group_id") if c in candidates.columns]
    return bad.union(candidates.groupBy(*keys).count().where("count > 1").select("candidate_id", F.lit("repeated").alias("problem")))


def rank(candidates: DataFrame, lower_is_better: bool = True, group: str | None = None) -> DataFrame:
    """Candidates with their rank from 1, best first; ties by id. Candidates are few: one per variant or producer.

    A missing or non-finite value and a candidate that stands twice in its group are refused: the ranks themselves
    raise, so the refusal can't be pruned and needs no job of its own. An empty table gives an empty result.
    """
    order = F.col("value").asc() if lower_is_better else F.col("value").desc()
    parts = [group] if group else []
    window = Window.partitionBy(*parts).orderBy(order, "candidate_id")
    same = F.count("*").over(Window.partitionBy(*parts, "candidate_id"))
    bad = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "candidate without a finite value: ").when(same > 1, "repeated candidate: ")
    refused = F.raise_error(F.concat(F.lit("campaign_validation: "), bad, F.coalesce(F.col("candidate_id").cast("string"), F.lit("null")))).cast("int")
    return candidates.withColumn("rank", F.when(bad.isNotNull(), refused).otherwise(F.row_number().over(window)))


def top_k(candidates: DataFrame, k: int = 1, lower_is_better: bool = True, group: str | None = None) -> DataFrame:
    return rank(candidates, lower_is_better, group).where(F.col("rank") <= k)


def refit_ensemble(predictions: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """The mean prediction of the k best producers per sample."""
    members = ranked.where(F.col("rank") <= k).select(F.col("candidate_id").alias("producer"))
    return predictions.join(F.broadcast(members), "producer").groupBy("sample_id").agg(F.avg("value").alias("value"), F.count("*").alias("n"))

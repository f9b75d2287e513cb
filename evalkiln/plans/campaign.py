"""A campaign from folds to a stacked model: FIT_CV, SELECT, REFIT and PREDICT as one plan per phase."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalkiln.operators import folds, metrics, models, predictions as P, select
from evalkiln.sources.stores import reread


@dataclass(frozen=True)
class Producer:
    """A named model: ``oof`` predicts rows with a fold from the other folds, ``final`` new rows from all of them."""

    name: str
    oof: Callable[[DataFrame], DataFrame]
    final: Callable[[DataFrame, DataFrame], DataFrame]


def group_mean(key: str) -> Producer:
    def final(train: DataFrame, rows: DataFrame) -> DataFrame:
        means = train.groupBy(key).agg(F.avg(F.col("y").cast("double")).alias("value"))
        return rows.join(means, key, "left")

    return Producer(f"m:{key}", lambda rows: models.group_mean_oof(rows, key), final)


@dataclass(frozen=True)
class Campaign:
    producers: tuple[Producer, ...]
    k: int = 5
    top: int = 2

    def fit_cv(self, samples: DataFrame) -> DataFrame:
        """Out-of-fold predictions of all producers; a gap, a value that isn't finite or a sample out of place is refused."""
        rows = reread(folds.with_fold(samples, self.k), [])
        parts = [p.oof(rows).select(F.lit(p.name).alias("producer"), F.lit("validation").alias("partition"), F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("fold_id"), "sample_id", F.lit("y").alias("target"), "value", "y") for p in self.producers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        P.check_campaign(out, folds.membership(rows, self.k), rows, [(p.name, "y") for p in self.producers])
        return out

    def ranking(self, oof: DataFrame) -> DataFrame:
        scores = metrics.report(oof, ["producer"], ("rmse",)).select(F.col("producer").alias("candidate_id"), F.col("rmse").alias("value"))
        return select.rank(scores)

    def predict(self, samples: DataFrame, new: DataFrame, ranking: DataFrame) -> DataFrame:
        """Refit on all samples and average the best producers over new rows; each uses only what covers the row.

        A new row that no producer covers stays, with a null value and n = 0.
        """
        parts = [p.final(samples, new).where("value is not null").select(F.lit(p.name).alias("producer"), "sample_id", "value") for p in self.producers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        found = select.refit_ensemble(out, ranking, self.top)
        return new.select("sample_id").join(found, "sample_id", "left").select("sample_id", "value", F.coalesce("n", F.lit(0)).alias("n"))


def example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to a key are the campaign's samples, the rest are new rows."""
    from evalkiln.sources.testdata import samples

    rows = reread(samples(spark, sf_dir), [])
    old, new = rows.where("k % 10 <> 0"), rows.where("k % 10 = 0").drop("y")
    campaign = Campaign((group_mean("segment"), group_mean("priority"), group_mean("group_id")))
    oof = campaign.fit_cv(old)
    P.strict(P.leakage_violations(oof), P.OofLeakage, "blocks that aren't out of fold")
    return campaign.predict(old, new, campaign.ranking(oof)).select("sample_id", F.round("value", 4).alias("value"), "n")

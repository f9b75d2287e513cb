"""Identity relations: units, constraints and their violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def effective_unit(level: Column, unit_id: Column, sample: Column, source: Column, observation: Column, derived: Column) -> Column:
    """The unit of a row: its own id if set, else the id its level stands for."""
    by_level = (
        F.when(level == "physical_sample", sample).when(level == "source_sample", F.concat_ws("::", sample, source))
        .when(level == "combo", derived).otherwise(observation)
    )
    return F.coalesce(unit_id, by_level)


def relation_violations(relations: DataFrame, weight_col: str = "weight") -> DataFrame:
    """(rule, subject): repeated observations, samples with several targets or groups, weights that aren't positive."""

    def many(key: str, value: str, rule: str) -> DataFrame:
        return relations.where(F.col(value).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).alias("subject"))

    repeated = relations.groupBy("observation_id").count().where("count > 1").select(F.lit("repeated_observation").alias("rule"), F.col("observation_id").alias("subject"))
    bad = relations.where(~(F.col(weight_col) > 0) | F.isnan(weight_col) | (F.col(weight_col) == float("inf"))).select(F.lit("weight").alias("rule"), F.col("observation_id").alias("subject"))
    return repeated.union(many("sample_id", "target_id", "several_targets")).union(many("sample_id", "group_id", "several_groups")).union(bad)


def combo_violations(combos: DataFrame, observations: DataFrame) -> DataFrame:
    """(combo_id, rule): components that are missing, repeated, the combo itself, or of another sample."""
    parts = combos.select("combo_id", "sample_id", F.explode("components").alias("component"))
    known = observations.select(F.col("observation_id").alias("component"), F.col("sample_id").alias("component_sample"))
    joined = parts.join(known, "component", "left")
    rule = F.when(F.col("component") == F.col("combo_id"), "self").when(F.col("component_sample").isNull(), "missing").when(F.col("component_sample") != F.col("sample_id"), "other_sample")
    bad = joined.select("combo_id", rule.alias("rule")).where("rule is not null")
    repeated = combos.where(F.size(F.array_distinct("components")) < F.size("components")).select("combo_id", F.lit("repeated").alias("rule"))
    return bad.union(repeated).distinct()


def excluded_samples(relations: DataFrame) -> DataFrame:
    """Samples of which any row is excluded."""
    return relations.groupBy("sample_id").agg(F.bool_or("excluded").alias("x")).where("x").select("sample_id")


def sample_map(relations: DataFrame, col: str) -> DataFrame:
    """sample -> target or group; one value per sample by ``relation_violations``, so any aggregate may pick it."""
    return relations.groupBy("sample_id").agg(F.max(col).alias(col))


def origin_leaks(members: DataFrame, origins: DataFrame) -> DataFrame:
    """(fold_id, sample_id, origin): derived samples on another side of a fold than their origin."""
    own = members.select("fold_id", "sample_id", "role")
    of_origin = members.select("fold_id", F.col("sample_id").alias("origin"), F.col("role").alias("origin_role"))
    return own.join(origins, "sample_id").join(of_origin, ["fold_id", "origin"]).where("role <> origin_role").select("fold_id", "sample_id", "origin")


def influence_weights(rows: DataFrame) -> DataFrame:
    """Each sample has the influence 1, shared equally by its rows."""
    return rows.withColumn("influence", 1.0 / F.count("*").over(Window.partitionBy("sample_id")))


def resample_equalised(rows: DataFrame, seed: int, id_col: str = "observation_id") -> DataFrame:
    """One row per sample, the first in the order of a seeded hash."""
    from evalkiln.functions.hashing import seed_key

    order = seed_key(seed, "resample", F.col(id_col))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("sample_id").orderBy(order, id_col))).where("__r = 1").drop("__r")


def merge_target_coverage(requested: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: how many requested samples have a target, and none, partial or complete."""
    c = requested.join(targets.select("sample_id", F.lit(1).alias("has")), "sample_id", "left").agg(F.count("*").alias("n_requested"), F.count("has").alias("n_covered"))
    state = F.when(F.col("n_covered") == 0, "none").when(F.col("n_covered") == F.col("n_requested"), "complete").otherwise("partial")
    return c.select("n_requested", "n_covered", state.alias("state"))


def influence_closure(scope: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id): groups and targets that the samples of a scope touch, and samples without a relation."""
    hit = relations.join(scope.select("sample_id").distinct(), "sample_id", "left_semi")
    groups = hit.select(F.lit("group").alias("kind"), F.col("group_id").alias("id"))
    targets = hit.select(F.lit("target").alias("kind"), F.col("target_id").alias("id"))
    missing = scope.join(relations, "sample_id", "left_anti").select(F.lit("missing").alias("kind"), F.col("sample_id").alias("id"))
    return groups.union(targets).union(missing).where("id is not null").distinct()


def compatibility(train: DataFrame, predict: DataFrame) -> DataFrame:
    """One row: samples, (sample, source) pairs and repetitions that differ between two relations."""
    a = train.groupBy("sample_id", "source_id").agg(F.count("*").alias("n_train"))
    b = predict.groupBy("sample_id", "source_id").agg(F.count("*").alias("n_predict"))
    both = a.join(b, ["sample_id", "source_id"], "full_outer")
    differs = F.coalesce("n_train", F.lit(0)) != F.coalesce("n_predict", F.lit(0))
    return both.agg(
        F.count_if(F.col("n_train").isNull() | F.col("n_predict").isNull()).alias("sources_differ"),
        F.count_if(differs & F.col("n_train").isNotNull() & F.col("n_predict").isNotNull()).alias("repetitions_differ"),
        F.count_distinct(F.when(differs, F.col("sample_id"))).alias("samples_affected"),
    )

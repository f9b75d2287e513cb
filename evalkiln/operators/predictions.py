"""Prediction tables: leakage and coverage checks, and joins by identity, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalkiln.checks import OofLeakage, OofValidation, strict
from evalkiln.operators import folds


def leakage_violations(predictions: DataFrame) -> DataFrame:
    """(producer, partition, fold_id) of every block that isn't of a validation partition."""
    return predictions.where("partition <> 'validation'").select("producer", "partition", "fold_id").distinct()


def scope_violations(predictions: DataFrame, members: DataFrame) -> DataFrame:
    """(producer, fold_id, sample_id) of validation rows outside the validation view of their fold."""
    view = members.where("role = 'validation'").select("fold_id", "sample_id")
    return predictions.where("partition = 'validation'").join(view, ["fold_id", "sample_id"], "left_anti").select("producer", "fold_id", "sample_id")


def fold_mismatch(predictions: DataFrame, members: DataFrame, partitions: tuple[str, ...] = ("validation",)) -> DataFrame:
    """(producer, fold_id, sample_id, problem): rows of a block that its fold lacks, or that it has and no one predicted.

    A block is what a producer says of one fold and partition; its samples have to be the fold's members of that role.
    """
    blocks = predictions.where(F.col("partition").isin(*partitions)).select("producer", "fold_id", "sample_id", F.col("partition").alias("role")).distinct()
    of_blocks = blocks.select("producer", "fold_id", "role").distinct()  # one row for each producer, fold and role
    wanted = members.where(F.col("role").isin(*partitions)).select("fold_id", "sample_id", "role").join(of_blocks, ["fold_id", "role"])
    both = blocks.withColumn("has", F.lit(1)).join(wanted.withColumn("wants", F.lit(1)), ["producer", "fold_id", "sample_id", "role"], "full_outer")
    return both.where("has is null or wants is null").select("producer", "fold_id", "sample_id", F.when(F.col("has").isNull(), "missing").otherwise("extra").alias("problem"))


def coverage(predictions: DataFrame, universe: DataFrame, resampled: bool = False) -> DataFrame:
    """Per producer: requested, covered, missing, extra and repeated samples, and whether that is complete."""
    counts = predictions.groupBy("producer", "sample_id").agg(F.count("*").alias("n"))
    known = universe.select("sample_id").distinct().withColumn("wants", F.lit(1))
    report = counts.join(known, "sample_id", "left").groupBy("producer").agg(
        F.count("wants").alias("n_covered"), F.count_if(F.col("wants").isNull()).alias("n_extra"), F.count_if(F.col("n") > 1).alias("n_repeated"),
    )
    size = F.broadcast(known.agg(F.count("*").alias("n_requested")))  # one row
    report = report.crossJoin(size).withColumn("n_missing", F.col("n_requested") - F.col("n_covered"))
    report = report.select("producer", "n_requested", "n_covered", "n_missing", "n_extra", "n_repeated")
    complete = (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.lit(resampled) | (F.col("n_repeated") == 0))
    return report.withColumn("complete", complete.cast("int"))


def oof_wide(predictions: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per sample, one column ``producer__target`` for each of ``columns``, in that order.

    The columns are given, so no job looks for them and their order doesn't depend on the data. A sample that lacks
    a value has null there; ``coverage`` counts those.
    """
    picked = [F.max(F.when((F.col("producer") == p) & (F.col("target") == t), F.col("value"))).alias(f"{p}__{t}".replace(":", "_")) for p, t in columns]
    return predictions.groupBy("sample_id").agg(*picked)


def campaign_violations(predictions: DataFrame, members: DataFrame, universe: DataFrame, resampled: bool = False, allow_train: bool = False) -> DataFrame:
    """(rule, producer, partition, fold_id, sample_id, problem): everything that forbids the join of one target.

    Rules, in the order in which they are told: ``folds`` (a sample in train and validation of one fold, twice in one role,
    unknown to the universe, or not validated exactly once; a fold without validation samples), ``requested`` (the
    universe repeats a sample), ``leakage`` (a block that isn't of a validation partition), ``block`` (no fold, an unknown
    one, or rows missing or extra in it), ``coverage`` (a producer without every sample exactly once) and ``value`` (null
    or not finite). With ``resampled`` a sample may be validated any number of times, but no sample may be left without a
    prediction; with ``allow_train`` blocks of train partitions are checked against the fold's train samples instead.
    """
    def label(rule: str, df: DataFrame, problem: Column) -> DataFrame:
        own = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("producer", "partition", "fold_id", "sample_id")]
        return df.select(F.lit(rule).alias("rule"), *own, problem.cast("string").alias("problem"))

    rows = predictions.select("producer", "partition", "fold_id", "sample_id", "value")
    known = universe.select("sample_id").distinct()
    by_fold = folds.fold_violations(members, known).where(F.lit(not resampled) | (F.col("rule") != "validated"))
    twice = members.groupBy("fold_id", "sample_id", "role").count().where("count > 1")
    unvalidated = members.groupBy("fold_id").agg(F.count_if(F.col("role") == "validation").alias("n")).where("n = 0")
    own_fold = rows.where(F.col("partition").isin("train", "validation"))
    unknown = own_fold.select("producer", "partition", "fold_id").distinct().join(members.select("fold_id").distinct(), "fold_id", "left_anti")
    not_finite = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    valid = rows.where("partition = 'validation'")
    out = (
        label("folds", by_fold, F.col("rule"))
        .unionByName(label("folds", twice, F.lit("repeated in one role")))
        .unionByName(label("folds", unvalidated, F.lit("no validation samples")))
        .unionByName(label("requested", universe.groupBy("sample_id").count().where("count > 1"), F.lit("requested twice")))
        .unionByName(label("block", unknown, F.when(F.col("fold_id").isNull(), "no fold").otherwise("unknown fold")))
        .unionByName(label("block", fold_mismatch(rows, members, ("train", "validation") if allow_train else ("validation",)), F.col("problem")))
        .unionByName(label("coverage", coverage(valid if allow_train else rows, known, resampled).where("complete = 0"), F.format_string("%d missing, %d extra, %d repeated", "n_missing", "n_extra", "n_repeated")))
        .unionByName(label("value", rows.where(not_finite), F.col("value")))
    )
    return out if allow_train else out.unionByName(label("leakage", leakage_violations(rows), F.lit("not of a validation partition")))


def judged(predictions: DataFrame, members: DataFrame, universe: DataFrame, columns: list[tuple[str, str]], resampled: bool = False, allow_train: bool = False) -> DataFrame:
    """(sample_id, ok): whether no rule of ``campaign_violations`` can be broken at a sample, for all of ``columns``.

    Predictions, memberships and requests of a sample meet in one aggregation: sets, which the tasks reduce before the
    shuffle, with the counts that show what is repeated. Nothing is joined. A fold without validation samples is a row of
    its own, without a sample.
    """
    none = lambda kind: F.lit(None).cast(kind)
    block, member = "struct<producer:string,target:string,partition:string,fold_id:string>", "struct<fold_id:string,role:string>"
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    name = lambda c: F.col(c).cast("string").alias(c)
    long = (
        predictions.select("sample_id", F.struct(*map(name, ("producer", "target", "partition", "fold_id"))).cast(block).alias("p"), bad.alias("bad"), none(member).alias("m"), F.lit(0).alias("u"))
        .unionByName(members.select("sample_id", none(block).alias("p"), F.lit(False).alias("bad"), F.struct(name("fold_id"), name("role")).cast(member).alias("m"), F.lit(0).alias("u")))
        .unionByName(universe.select("sample_id", none(block).alias("p"), F.lit(False).alias("bad"), none(member).alias("m"), F.lit(1).alias("u")))
    )
    one = long.groupBy("sample_id").agg(
        F.collect_set("p").alias("p"), F.count("p").alias("n_p"), F.max("bad").alias("bad"), F.collect_set("m").alias("m"), F.count("m").alias("n_m"), F.sum("u").alias("n_u")
    )
    folds_of = lambda role: F.transform(F.filter("m", lambda m: m["role"] == role), lambda m: m["fold_id"])
    validated, trained = folds_of("validation"), folds_of("train")
    times = F.size(validated) if resampled else F.lit(1)
    of = lambda p, t: F.size(F.filter("p", lambda x: (x["producer"] == p) & (x["target"] == t) & (x["partition"] == "validation")))
    fits = lambda x: F.coalesce(F.when(x["partition"] == "validation", F.array_contains(validated, x["fold_id"])).when(F.lit(allow_train) & (x["partition"] == "train"), F.array_contains(trained, x["fold_id"])).otherwise(F.lit(allow_train)), F.lit(False))
    fine = [
        F.col("n_u") == 1, F.size("m") == F.col("n_m"), F.size("p") == F.col("n_p"), ~F.col("bad"), F.size(F.array_intersect(validated, trained)) == 0,
        F.lit(True) if resampled else F.size(validated) == 1, F.forall("p", fits), *[(of(p, t) == times) & (times > 0) for p, t in columns],
    ]
    every = fine[0]
    for c in fine[1:]:
        every = every & c
    unvalidated = members.groupBy("fold_id").agg(F.count_if(F.col("role") == "validation").alias("n")).where("n = 0")
    return one.select("sample_id", F.coalesce(every, F.lit(False)).alias("ok")).unionByName(unvalidated.select(F.lit(None).cast(one.schema["sample_id"].dataType).alias("sample_id"), F.lit(False).alias("ok")))


RULES = ("folds", "requested", "leakage", "block", "coverage", "value")


def check_campaign(predictions: DataFrame, members: DataFrame, universe: DataFrame, columns: list[tuple[str, str]], resampled: bool = False, allow_train: bool = False) -> None:
    """Raise OofLeakage or OofValidation if anything forbids the join; one job for all rules, producers and targets.

    Only if a sample is in doubt are the violations of each target looked up, for the message; with ``allow_train`` always,
    since a missing row of a train block shows in no other. A campaign without samples is refused.
    """
    seen = judged(predictions, members, universe, columns, resampled, allow_train).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
    if not seen.n:
        raise OofValidation("requested: no samples")
    if not seen.bad and not allow_train:
        return
    for target in dict.fromkeys(t for _, t in columns):
        rank = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
        bad = campaign_violations(predictions.where(F.col("target") == target), members, universe, resampled, allow_train).orderBy(rank, "producer", "fold_id", "sample_id").limit(20).collect()
        lone = [c for c in columns if c[1] == target]
        if not bad and (gone := {p for p, _ in lone} - {r[0] for r in predictions.where(F.col("target") == target).select("producer").distinct().collect()}):
            raise OofValidation(f"coverage: no predictions of {sorted(gone)} for {target}")
        if bad:
            error = OofLeakage if any(r.rule == "leakage" for r in bad) and bad[0].rule in ("leakage", "block", "coverage", "value") else OofValidation
            raise error(f"{bad[0].rule}: {[r.asDict() for r in bad]}", bad)


def oof_campaign(predictions: DataFrame, members: DataFrame, universe: DataFrame, columns: list[tuple[str, str]], resampled: bool = False) -> DataFrame:
    """Check the fold set, the requested samples, leakage, blocks, coverage and values of every target, then join.

    Raises before anything is joined. ``columns`` are the producers and targets asked for; blocks of others are checked
    for leakage and their folds too. Resampled validation rows are averaged.
    """
    check_campaign(predictions, members, universe, columns, resampled)
    if resampled:
        predictions = predictions.groupBy("producer", "target", "sample_id").agg(F.avg("value").alias("value"))
    return oof_wide(predictions, columns)


def refit_decision(report: DataFrame, policy: str) -> DataFrame:
    """(producer, decision, cause) of a stacker's refit under require_full_coverage, cv_only or skip_refit_on_incomplete_oof."""
    full = F.col("complete") == 1
    if policy == "cv_only":
        decision, cause = F.lit("skip"), F.lit("cv_only")
    elif policy == "skip_refit_on_incomplete_oof":
        decision, cause = F.when(full, "allow").otherwise("skip"), F.when(full, "complete").otherwise("incomplete_oof")
    else:
        decision, cause = F.when(full, "allow").otherwise("error"), F.when(full, "complete").otherwise("incomplete_oof")
    return report.select("producer", decision.alias("decision"), cause.alias("cause"))


def meta_features(predictions: DataFrame, average: bool = False) -> DataFrame:
    """(producer, sample_id, target, value): out-of-fold rows for a stacker; repeats are averaged only where allowed."""
    rows = predictions.where("partition = 'validation'")
    if not average:
        strict(rows.groupBy("producer", "sample_id", "target").count().where("count > 1"), OofValidation, "a sample is predicted twice")
        return rows.select("producer", "sample_id", "target", "value")
    return rows.groupBy("producer", "sample_id", "target").agg(F.avg("value").alias("value"))


def off_fold(predictions: DataFrame, partition: str) -> DataFrame:
    """Rows of a partition without a fold: ``test`` for REFIT, ``final`` for PREDICT."""
    return predictions.where((F.col("partition") == partition) & F.col("fold_id").isNull())


def unit_leaks(predictions: DataFrame, members: DataFrame, units: DataFrame, unit_col: str) -> DataFrame:
    """(fold_id, unit): units whose samples a fold has both in train and in validation."""
    sides = members.join(units.select("sample_id", unit_col), "sample_id").select("fold_id", F.col(unit_col).alias("unit"), "role").distinct()
    both = sides.where("role = 'train'").select("fold_id", "unit").intersect(sides.where("role = 'validation'").select("fold_id", "unit"))
    return both.join(F.broadcast(predictions.select("fold_id").distinct()), "fold_id", "left_semi")


def requested_order(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows with the position that the caller asked for."""
    return rows.join(requested.select("sample_id", "position"), "sample_id")


def concat_branches(branches: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The disjoint union of branches, and its violations (sample_id, problem): overlap, foreign or missing samples."""
    counts = branches.groupBy("sample_id").agg(F.count_distinct("branch").alias("n"))
    both = counts.join(universe.select("sample_id", F.lit(1).alias("wants")), "sample_id", "full_outer")
    problem = F.when(F.col("wants").isNull(), "foreign").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "overlap")
    return branches.select("sample_id", "target", "value"), both.select("sample_id", problem.alias("problem")).where("problem is not null")

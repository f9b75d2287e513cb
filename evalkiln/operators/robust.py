"""Robustness by slice, domain support and decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evalkiln.checks import CampaignValidation
from evalkiln.functions import counter_rng
from evalkiln.operators import conformal, gram


def severities(rows: DataFrame, kind: str, levels: tuple[float, ...], column: str = "value") -> DataFrame:
    """Each row at each severity; 0 is the identity. shift adds severity times 100, dropout zeroes what a hash picks."""
    at = rows.withColumn("severity", F.explode(F.array(*[F.lit(float(s)) for s in levels])))
    if kind == "shift":
        return at.withColumn(column, F.col(column) + F.col("severity") * 100)
    chance = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(kind), "sample_id"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return at.withColumn(column, F.when(chance < F.col("severity"), 0.0).otherwise(F.col(column)))


def noisy(rows: DataFrame, levels: tuple[float, ...], seed: int, column: str = "value", id_col: str = "sample_id") -> DataFrame:
    """Each row at each severity with Gaussian noise of that deviation, from a counter of the row; 0 is the identity."""
    at = rows.withColumn("severity", F.explode(F.array(*[F.lit(float(s)) for s in levels])))
    block = counter_rng.philox(counter_rng.counter_words(counter_rng.sequence(counter_rng.text(F.col(id_col)), counter_rng.text(F.lit("gaussian_noise")))), seed)
    half = lambda b, i: (F.get(b, F.lit(i)) + F.lit(0.5)) / F.lit(4294967296.0)
    normal = F.transform(F.array(block), lambda b: F.sqrt(-2 * F.ln(half(b, 0))) * F.cos(2 * math.pi * half(b, 1)))[0]
    return at.withColumn(column, F.when(F.col("severity") == 0, F.col(column)).otherwise(F.col(column) + F.col("severity") * normal))


MODES = ("clean_frozen", "matched_recalibration", "structural_refit")
KINDS = ("identity", "ordered_axis_shift", "gaussian_noise", "dropout", "node_replacement")


def _checked_severities(kind: str, levels: tuple[float, ...]) -> list[float]:
    """Severities begin with 0 (identity), rise and are finite; the identity has no other."""
    if kind not in KINDS:
        raise CampaignValidation(f"no such perturbation: {kind}")
    if not levels or levels[0] != 0 or any(not math.isfinite(v) or v < 0 for v in levels) or any(a >= b for a, b in zip(levels, levels[1:])) or (kind == "identity" and len(levels) > 1):
        raise CampaignValidation("severities begin with 0, rise and are finite; the identity has 0 only")
    return [float(v) for v in levels]


def axis_shifted(x: Column, by: Column) -> Column:
    """An array along an ordered axis, moved by a number of steps: linear between neighbours, the ends go on as they are."""
    last = F.size(x) - 1

    def at(i: Column) -> Column:
        place = F.least(F.greatest(i + by, F.lit(0.0)), last.cast("double"))
        low = F.floor(place).cast("int")
        part = place - low
        return F.get(x, low) * (1 - part) + F.when(part > 0, F.get(x, F.least(low + 1, last)) * part).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), last), at)


def perturbed(rows: DataFrame, kind: str, levels: tuple[float, ...], x: str = "x", id_col: str = "sample_id", seed: int = 0, nodes: tuple[int, ...] = (), replacement: float = 0.0) -> DataFrame:
    """Each row at each severity (``severity``, ``severity_index``) with the array ``x`` perturbed; severity 0 is the row itself.

    ordered_axis_shift moves the axis by the severity in steps; gaussian_noise adds noise of that deviation, dropout zeroes
    cells with that chance, both from a hash of seed, kind, id and cell, so the same cells at every severity;
    node_replacement draws the features ``nodes`` towards ``replacement`` by the severity, wholly at 1.
    """
    found = _checked_severities(kind, levels)
    at = rows.select("*", F.posexplode(F.array(*[F.lit(v) for v in found])).alias("severity_index", "severity"))
    old, s = F.col(x).cast("array<double>"), F.col("severity")
    half = lambda i, part: (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(kind), F.col(id_col).cast("string"), i), 256), 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    if kind == "ordered_axis_shift":
        new = axis_shifted(old, s)
    elif kind == "gaussian_noise":
        new = F.transform(old, lambda v, i: v + s * F.sqrt(-2 * F.ln(half(i, 0))) * F.cos(2 * math.pi * half(i, 1)))
    elif kind == "dropout":
        new = F.transform(old, lambda v, i: F.when(half(i, 0) < s, 0.0).otherwise(v))
    elif kind == "node_replacement":
        by = F.least(s, F.lit(1.0))
        new = F.transform(old, lambda v, i: F.when(i.isin(*nodes), v * (1 - by) + F.lit(float(replacement)) * by).otherwise(v))
    else:
        new = old
    return at.withColumn(x, F.when(s == 0, old).otherwise(new))


def scenario(rows: DataFrame, kind: str, levels: tuple[float, ...], mode: str, fit, coverage: float = 0.9, nodes: tuple[int, ...] = (), x: str = "x", y: str = "y", id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """(severity, n, rmse, mae, radius, coverage, refit, recalibrated) of a model under perturbation.

    ``rows`` has ``role``: train, calibration or test. ``clean_frozen`` perturbs the test rows alone; in
    ``matched_recalibration`` the calibration rows are perturbed too and each severity has its own radius;
    ``structural_refit``, which is for node_replacement and for that only, also fits a model for each severity on train
    rows whose nodes are replaced. All severities are one pass for the models, one for the radii and one for the scores.
    """
    if mode not in MODES or (kind == "node_replacement") != (mode == "structural_refit"):
        raise CampaignValidation(f"{kind} can't be run in the mode {mode}")
    if mode == "structural_refit" and not nodes:
        raise CampaignValidation("a structural refit needs the nodes that are replaced")
    mark = lambda role, kind, levels: perturbed(rows.where(F.col("role") == role), kind, levels, x, id_col, seed, nodes)
    refit, recalibrated = mode == "structural_refit", mode != "clean_frozen"
    train = mark("train", *((kind, levels) if refit else ("identity", (0.0,))))
    moments = gram.fold_moments(train, x, [y], "severity_index")
    moments = gram.FoldMoments(moments.own, moments.shift, moments.dims, trained=True)
    models = gram.fit_folds(moments, fit)
    model_of = F.col("severity_index") if refit else F.lit(0)
    calibration = gram.predict(mark("calibration", *((kind, levels) if recalibrated else ("identity", (0.0,)))), models, x, ["value"], model_of)
    residuals = calibration.select("severity_index", F.abs(F.col("value") - F.col(y)).alias("residual"))
    radii = conformal.quantiles(residuals, conformal.coverages(rows.sparkSession, (coverage,)), ("severity_index",)).select(F.col("severity_index").alias("__r"), "radius")
    test = gram.predict(mark("test", kind, levels), models, x, ["value"], model_of)
    joined = test.join(F.broadcast(radii), (F.col("severity_index") if recalibrated else F.lit(0)) == F.col("__r"))  # a row for each severity
    e = F.col("value") - F.col(y)
    inside = F.coalesce((F.abs(e) <= F.col("radius")).cast("double"), F.lit(1.0))  # no radius is an unbounded interval
    out = joined.groupBy("severity").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max("radius").alias("radius"), F.avg(inside).alias("coverage"))
    return out.withColumn("refit", F.lit(refit)).withColumn("recalibrated", F.lit(recalibrated))


def slices(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Metrics for all rows and for each value of each slicing column: one pass with grouping sets."""
    e = F.col("value") - F.col("y")
    sets = [[F.col(k) for k in keys], *[[F.col(k) for k in keys] + [F.col(d)] for d in dims]]
    return rows.groupingSets(sets, *[F.col(k) for k in keys], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def support(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """test with n_outside and state: within the range of the training rows in every feature or not, null is unknown."""
    box = train.agg(*[F.min(f).alias(f"min_{f}") for f in features], *[F.max(f).alias(f"max_{f}") for f in features])
    joined = test.crossJoin(F.broadcast(box))  # one row
    outside = sum((F.when((F.col(f) < F.col(f"min_{f}")) | (F.col(f) > F.col(f"max_{f}")), 1).otherwise(0) for f in features), F.lit(0))
    unknown = F.greatest(*[F.col(f).isNull() for f in features]) if len(features) > 1 else F.col(features[0]).isNull()
    state = F.when(unknown, "unknown").when(outside == 0, "in_support").otherwise("out_of_support")
    return joined.withColumn("n_outside", outside).withColumn("state", state).drop(*[f"{m}_{f}" for f in features for m in ("min", "max")])


def decide(rows: DataFrame, value: str, accept_below: float, reject_above: float) -> DataFrame:
    """accept, refer or reject by two thresholds; null is referred."""
    v = F.col(value)
    return rows.withColumn("decision", F.when(v < accept_below, "accept").when(v > reject_above, "reject").otherwise("refer"))

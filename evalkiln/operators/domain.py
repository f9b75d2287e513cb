"""Is a row inside the domain of the training rows: leverage, density ratio, and decisions on such evidence.

Each method gives a score, a threshold and whether the row is supported; null is unknown, where a feature is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalkiln.checks import CampaignValidation
from evalkiln.operators.gram import FoldMoments, Moments

IN, OUT, UNKNOWN = "in_support", "out_of_support", "unknown"
METHOD = "struct<method_id:string,score:double,threshold:double,supported:boolean>"


def _finite(x: str) -> Column:
    return F.coalesce(F.forall(F.col(x), lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))


def _method(name: str, score: Column, threshold: float) -> Column:
    """One method's evidence; all unknown where the score is."""
    known = score.isNotNull()
    return F.struct(F.lit(name).alias("method_id"), score.alias("score"), F.when(known, F.lit(float(threshold))).alias("threshold"), (score <= threshold).alias("supported")).cast(METHOD)


def leverage(rows: DataFrame, train: Moments, x: str = "x", threshold: float | None = None, name: str = "leverage") -> DataFrame:
    """``rows`` with the column ``name``: 1/n + (x - mean)' S^-1 (x - mean), S the centred cross-products of the train rows.

    The default threshold is three times the mean leverage of a train row. Directions that the train rows don't vary in
    count only by leaving them: a row off that plane has an infinite score. Only p x p numbers are sent to the tasks.
    """
    p = len(train.xx)
    values, vectors = np.linalg.eigh(train.xx)
    flat = values <= max(values.max(initial=0.0), 0.0) * 1e-12
    root = vectors[:, ~flat] / np.sqrt(values[~flat])
    off = vectors[:, flat]
    size = max(1.0, float(np.abs(train.x_mean).max(initial=0.0)), float(np.sqrt(max(values.max(initial=0.0), 0.0) / max(train.n, 1.0))))
    limit = 3.0 * (p + 1) / train.n if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z")
            fits = np.asarray(z.value_lengths().fill_null(-1)) == p
            score = np.full(batch.num_rows, np.nan)
            d = z.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - train.x_mean
            own = 1 / train.n + np.square(d @ root).sum(axis=1)
            own[(np.abs(d @ off) > 1e-6 * size).any(axis=1)] = np.inf
            score[fits] = own
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64(), from_pandas=True)], names=["row", "score"])

    given = rows.select(F.struct(*rows.columns).alias("row"), F.when(_finite(x), F.col(x).cast("array<double>")).alias("z"))
    out = given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", _method("leverage", F.col("score"), limit).alias(name))


def separating_models(rows: DataFrame, x: str, moments: FoldMoments, fold: str = "fold", is_test: str = "is_test", penalty: float = 1.0, rounds: int = 12) -> dict[int, np.ndarray]:
    """fold -> coefficients (intercept first, on standardised features) of a logistic model that tells test from train rows.

    The model of a fold is learned from the other folds. A Newton step is one pass: the tasks add up gradients and Hessians
    of all folds' models, each p x p. The penalty keeps separable rows finite; steps end early once nothing moves.
    """
    whole = moments.train()
    sd = np.sqrt(np.maximum(np.diag(whole.xx) / whole.n, 0.0))
    sd[sd == 0] = 1.0
    numbers = sorted(moments.own)
    p = len(sd) + 1
    models = {f: np.zeros(p) for f in numbers}
    given = rows.select(F.col(fold).cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(is_test).cast("double").alias("t")).where(_finite(x))

    for _ in range(rounds):
        now = dict(models)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros((p, p + 1)) for f in numbers}
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = (batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - whole.x_mean) / sd
                z = np.column_stack((np.ones(len(z)), z))
                t, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "fold"))
                for f in numbers:
                    m = z[folds != f]
                    q = 1 / (1 + np.exp(-np.clip(m @ now[f], -500, 500)))
                    sums[f][:, :p] += m.T @ (m * (q * (1 - q))[:, None])
                    sums[f][:, p] += m.T @ (t[folds != f] - q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(numbers, p * (p + 1)), pa.int32()), pa.array(np.tile(np.arange(p * (p + 1)), len(numbers)), pa.int32()), pa.array(np.concatenate([sums[f].ravel() for f in numbers]))],
                names=["fold", "cell", "value"],
            )

        total = given.mapInArrow(run, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toPandas()
        ridge = penalty * np.eye(p)
        ridge[0, 0] = 0.0
        moved = 0.0
        for f in numbers:
            part = total[total.fold == f].sort_values("cell").value.to_numpy().reshape(p, p + 1)
            step = np.linalg.solve(part[:, :p] + ridge + 1e-9 * np.eye(p), part[:, p] - ridge @ now[f])
            models[f] = now[f] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return models


def density_ratio(rows: DataFrame, x: str, moments: FoldMoments, models: dict[int, np.ndarray], n_train: int, n_test: int, threshold: float, fold: str = "fold", name: str = "density_ratio") -> DataFrame:
    """``rows`` with the column ``name``: the estimated density of test rows over that of train rows, by the model of the row's fold.

    Cross-fitted: no row is scored by a model that saw it. A high ratio means rows that training hardly had.
    """
    whole = moments.train()
    sd = np.sqrt(np.maximum(np.diag(whole.xx) / whole.n, 0.0))
    sd[sd == 0] = 1.0
    table = rows.sparkSession.createDataFrame([(f, float(m[0] - (m[1:] / sd) @ whole.x_mean), [float(v) for v in m[1:] / sd]) for f, m in models.items()], "__fold int, __b double, __w array<double>")
    joined = rows.join(F.broadcast(table), F.col(fold).cast("int") == F.col("__fold"), "left")  # a row for each fold
    log = F.col("__b") + F.aggregate(F.zip_with(F.col(x), F.col("__w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    ratio = F.when(_finite(x), F.exp(log) * (n_train / n_test))
    return joined.withColumn(name, _method("density_ratio", ratio, threshold)).drop("__fold", "__b", "__w")


def assess(rows: DataFrame, methods: list[str], name: str = "status") -> DataFrame:
    """``rows`` with ``methods`` (all evidence, by method) and ``name``: out of support if any method says so, in support if
    all do, else unknown. At least one method; two of one name are refused."""
    if not methods or len(set(methods)) < len(methods):
        raise CampaignValidation("domain methods have to be named, once each")
    every = F.array_sort(F.array(*[F.col(m) for m in methods]))
    supported = [F.col(m)["supported"] for m in methods]
    no, yes = F.lit(False), F.lit(True)
    for s in supported:
        no, yes = no | F.coalesce(~s, F.lit(False)), yes & F.coalesce(s, F.lit(False))
    return rows.withColumn(name, F.when(no, OUT).when(yes, IN).otherwise(UNKNOWN)).withColumn("methods", every).drop(*[m for m in methods if m != "methods"])


@dataclass(frozen=True)
class Threshold:
    """A rule on a column; a row that breaks it gets the outcome ``otherwise`` (refer or reject)."""

    name: str
    column: str
    operator: str
    value: Any
    otherwise: str = "refer"

    def holds(self) -> Column:
        c = F.col(self.column)
        if self.operator in ("lt", "lte", "gt", "gte"):
            if isinstance(self.value, bool) or not isinstance(self.value, (int, float)) or not np.isfinite(self.value):
                raise CampaignValidation(f"threshold {self.name} needs a finite number")
            return {"lt": c < self.value, "lte": c <= self.value, "gt": c > self.value, "gte": c >= self.value}[self.operator] & ~F.isnan(c.cast("double"))
        if self.operator in ("in", "not_in"):
            if not isinstance(self.value, (list, tuple, set)) or not self.value:
                raise CampaignValidation(f"threshold {self.name} needs values")
            return c.isin(*self.value) if self.operator == "in" else ~c.isin(*self.value)
        raise CampaignValidation(f"threshold {self.name}: unknown operator {self.operator}")


def decide(rows: DataFrame, thresholds: list[Threshold]) -> DataFrame:
    """``rows`` with ``decision`` and ``reasons``: accept if every rule holds, reject if a broken one says so, else refer.

    A rule whose column is null is neither kept nor broken: the row is referred for missing evidence. Reasons are the
    sorted names of the rules, with ``:missing`` where evidence was, and ``all_thresholds_hold`` for what is accepted.
    """
    if not thresholds or len({t.name for t in thresholds}) < len(thresholds) or {t.otherwise for t in thresholds} - {"refer", "reject"}:
        raise CampaignValidation("thresholds have to be named, once each, with refer or reject as outcome")
    broken, rejected, reasons = F.lit(False), F.lit(False), []
    for t in thresholds:
        holds = t.holds()
        bad = F.coalesce(~holds, F.lit(True))
        broken = broken | bad
        rejected = rejected | (F.coalesce(~holds, F.lit(False)) if t.otherwise == "reject" else F.lit(False))
        reasons.append(F.when(holds.isNull(), f"{t.name}:missing").when(bad, t.name))
    why = F.array_sort(F.array_compact(F.array(*reasons)))
    return rows.withColumn("decision", F.when(rejected, "reject").when(broken, "refer").otherwise("accept")).withColumn("reasons", F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("all_thresholds_hold"))))

"""Linear models from cross-products: one pass over the rows serves every fold and every variant.

The tasks add up the products of all pairs of columns for each fold; what a fold trains on is the total minus its own
part, so no fold is materialised and the rows are never sorted or collected. Models are solved from matrices of
``dims`` x ``dims`` numbers (at most ``MAX_DIMS``), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalkiln.checks import CampaignValidation, OofValidation

MAX_DIMS = 512
#: Coefficients that may be sent to every task; more of them are scored in several passes.
MODEL_CELLS = 4_000_000
#: Where the model of all rows stands among those of the folds.
ALL = -1


@dataclass(frozen=True)
class Moments:
    """Counts, means and centred cross-products of some rows: features x, targets y."""

    n: float
    x_mean: np.ndarray
    y_mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray


@dataclass(frozen=True)
class FoldMoments:
    """The cross-products of each fold's own rows, of columns shifted by ``shift``; with ``trained`` those of its train rows."""

    own: dict[int, np.ndarray]
    shift: np.ndarray
    dims: int
    trained: bool = False

    def train(self, fold: int = ALL) -> Moments:
        """Of what a fold trains on: all rows outside it, or its own train rows; of all rows for ALL."""
        if self.trained:
            if fold not in self.own:
                raise OofValidation(f"fold {fold} has no rows to train on")
            m = self.own[fold]
        else:
            m = sum((v for f, v in self.own.items() if f != fold), np.zeros_like(next(iter(self.own.values()))))
        n, p = m[0, 0], self.dims
        if n < 1:
            raise OofValidation(f"fold {fold} has no rows to train on")
        mean = m[0, 1:] / n
        c = m[1:, 1:] - n * np.outer(mean, mean)
        mean = mean + self.shift
        return Moments(n, mean[:p], mean[p:], c[:p, :p], c[:p, p:], c[p:, p:])


def fold_moments(rows: DataFrame, x: str, ys: list[str], fold: str | None = "fold", weight: str | None = None) -> FoldMoments:
    """Cross-products by fold of the array column ``x`` and the columns ``ys``; one pass, a partial sum for each task and fold.

    Columns are shifted by one row's values first, which keeps the digits of columns far from zero. Arrays of another
    length and values that are null or not finite are refused with their number. ``weight`` multiplies a row's products.
    """
    values = F.concat(F.col(x).cast("array<double>"), F.array(*[F.col(y).cast("double") for y in ys]) if ys else F.array().cast("array<double>"))
    given = rows.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), values.alias("z"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    some = given.where(F.forall("z", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))).select("z").first()
    if some is None:
        raise OofValidation("no row with finite values to learn from")
    shift = np.array(some.z)
    width = len(shift)
    if width > MAX_DIMS:
        raise ValueError(f"{width} columns, at most {MAX_DIMS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        bad = 0
        for batch in batches:
            z, folds, weights = batch.column("z"), batch.column("fold").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)
            fits = np.asarray(z.value_lengths().fill_null(-1)) == width
            flat = z.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            folds, weights = folds[fits], weights[fits]
            good = np.isfinite(flat).all(axis=1) & np.isfinite(weights) & (folds == folds)
            bad += len(fits) - int(good.sum())
            m = np.column_stack((np.ones(int(good.sum())), flat[good] - shift))
            for f in np.unique(folds[good]):
                own = folds[good] == f
                part = m[own].T @ (m[own] * weights[good][own, None])
                sums[int(f)] = sums.get(int(f), 0) + part
        at = np.triu_indices(width + 1)
        cells = np.concatenate([*(np.arange(len(at[0])) for _ in sums), [-1]])
        owner = np.concatenate([*(np.full(len(at[0]), f) for f in sums), [0]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner, pa.int32()), pa.array(cells, pa.int32()), pa.array(np.concatenate([*(s[at] for s in sums.values()), [float(bad)]]))], names=["fold", "cell", "value"]
        )

    total = given.mapInArrow(run, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toPandas()
    refused = total.loc[total.cell < 0, "value"].sum()
    if refused:
        raise OofValidation(f"{refused:.0f} rows have missing or non-finite values")
    at = np.triu_indices(width + 1)
    own = {}
    for f, part in total[total.cell >= 0].groupby("fold"):
        m = np.zeros((width + 1, width + 1))
        cell, value = part.cell.to_numpy(), part.value.to_numpy()
        m[at[0][cell], at[1][cell]] = m[at[1][cell], at[0][cell]] = value
        own[int(f)] = m
    return FoldMoments(own, shift, width - len(ys))


def resampled_moments(rows: DataFrame, members: DataFrame, x: str, ys: list[str]) -> FoldMoments:
    """What each fold of a resampled set trains on: its train members, each as often as ``times`` says.

    ``members`` has fold_id (``fold`` and a number), sample_id, role and may have times. A sample stands in several
    folds, so its products are added to each; that is one join by sample and no row twice.
    """
    number = F.substring("fold_id", 5, 9).cast("int").alias("__of")
    times = F.col("times") if "times" in members.columns else F.lit(1)
    train = members.where("role = 'train'").select("sample_id", number, times.cast("double").alias("__times"))
    found = fold_moments(rows.join(train, "sample_id"), x, ys, "__of", "__times")
    return FoldMoments(found.own, found.shift, found.dims, trained=True)


def resampled_oof(rows: DataFrame, members: DataFrame, models: list[Model], x: str, name: str = "value") -> DataFrame:
    """(sample_id, value, n): the mean of a sample's predictions by the models of all folds that validate it; n = 0 and null if none does."""
    valid = members.where("role = 'validation'").select("sample_id", F.substring("fold_id", 5, 9).cast("int").alias("__of"))
    each = predict(rows.join(valid, "sample_id"), models, x, [name], "__of").groupBy("sample_id").agg(F.avg(name).alias(name), F.count(name).alias("n"))
    return rows.select("sample_id").join(each, "sample_id", "left").select("sample_id", name, F.coalesce("n", F.lit(0)).alias("n"))


#: From moments to coefficients, one column for each target.
Fit = Callable[[Moments], np.ndarray]


def ridge(penalty: float = 0.0, columns: list[int] | None = None) -> Fit:
    """Least squares with a penalty on all coefficients but the intercept; others than ``columns`` stay 0. Ties by the least norm."""

    def fit(m: Moments) -> np.ndarray:
        use = np.arange(len(m.xx)) if columns is None else np.array(columns)
        out = np.zeros_like(m.xy)
        left = m.xx[np.ix_(use, use)] + penalty * np.eye(len(use))
        try:
            out[use] = np.linalg.solve(left, m.xy[use])
        except np.linalg.LinAlgError:
            out[use] = np.linalg.pinv(left, hermitian=True) @ m.xy[use]
        return out

    return fit


def simpls(components: int) -> Fit:
    """Partial least squares by SIMPLS, on the cross-products alone; stops early where nothing is left to explain."""

    def fit(m: Moments) -> np.ndarray:
        s, basis, weights, loadings = m.xy.copy(), [], [], []
        size = np.abs(m.xy).max(initial=0.0)
        for _ in range(min(components, len(m.xx))):
            if np.abs(s).max(initial=0.0) <= 1e-12 * size or not size:
                break
            r = s[:, 0] / np.linalg.norm(s[:, 0]) if s.shape[1] == 1 else np.linalg.svd(s, full_matrices=False)[0][:, 0]
            length = np.sqrt(r @ m.xx @ r)
            if not length > 0:
                break
            r = r / length
            p = m.xx @ r
            v = p.copy()
            for _ in range(2):  # once more for the digits
                for b in basis:
                    v -= b * (b @ v)
            v /= np.linalg.norm(v)
            s -= np.outer(v, v @ s)
            basis.append(v)
            weights.append(r)
            loadings.append(m.xy.T @ r)
        return np.array(weights).T @ np.array(loadings) if weights else np.zeros_like(m.xy)

    return fit


@dataclass(frozen=True)
class Model:
    """A linear model that a fold's rows weren't part of (ALL: of all rows)."""

    variant: str
    fold: int
    coef: np.ndarray
    intercept: np.ndarray


def fit_folds(moments: FoldMoments, fit: Fit, variant: str = "model", refit: bool = False) -> list[Model]:
    """One model for each fold, and with ``refit`` one of all rows."""
    out = []
    for f in [*sorted(moments.own), *([ALL] if refit else [])]:
        m = moments.train(f)
        coef = fit(m)
        out.append(Model(variant, f, coef, m.y_mean - m.x_mean @ coef))
    return out


def fit_variants(spark: SparkSession, moments: FoldMoments, variants: dict[str, Fit], refit: bool = False) -> list[Model]:
    """The models of all variants and folds, solved by the tasks; a variant that can't be solved is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["variant"]:
                try:
                    found = fit_folds(moments, variants[name], name, refit)
                except np.linalg.LinAlgError:
                    continue
                yield pd.DataFrame({"variant": name, "fold": [m.fold for m in found], "coef": [m.coef.ravel() for m in found], "intercept": [m.intercept for m in found]})

    names = spark.createDataFrame([(v,) for v in sorted(variants)], "variant string").repartition(min(len(variants), max(1, spark.sparkContext.defaultParallelism)), "variant")
    rows = names.mapInPandas(run, "variant string, fold int, coef array<double>, intercept array<double>").collect()
    return sorted((Model(r.variant, r.fold, np.array(r.coef).reshape(moments.dims, -1), np.array(r.intercept)) for r in rows), key=lambda m: (m.variant, m.fold))


def predict(rows: DataFrame, models: list[Model], x: str, names: list[str], fold: str | Column = "fold") -> DataFrame:
    """``rows`` with one column of predictions for each target, by the model of the row's fold; null where there is none.

    The models are a few rows of ``dims`` numbers each; the products stay inside Spark's expressions.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(m.fold, [[float(v) for v in c] for c in m.coef.T], [float(v) for v in m.intercept]) for m in models], "__fold int, __coef array<array<double>>, __intercept array<double>")
    at = F.col(fold) if isinstance(fold, str) else fold
    joined = rows.withColumn("__at", at.cast("int")).join(F.broadcast(table), F.col("__at") == F.col("__fold"), "left")
    dot = lambda i: F.aggregate(F.zip_with(F.col(x), F.col("__coef")[i], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("__intercept")[i]
    return joined.withColumns({n: dot(i) for i, n in enumerate(names)}).drop("__at", "__fold", "__coef", "__intercept")


def score_variants(rows: DataFrame, models: list[Model], x: str, y: str, fold: str = "fold") -> DataFrame:
    """(variant_id, fold_id, n, mse, rmse, mae, r2) of out-of-fold predictions, for each fold and, as ``avg``, for all rows.

    All variants and folds are one pass: a task multiplies its rows with the coefficients of all variants of their fold
    and adds up errors, so no prediction is shuffled. Models of more than ``MODEL_CELLS`` coefficients take several passes.
    """
    spark = rows.sparkSession
    names = sorted({m.variant for m in models})
    empty = "variant_id string, fold_id string, n bigint, mse double, rmse double, mae double, r2 double"
    if not names:
        return spark.createDataFrame([], empty)
    each = max(1, MODEL_CELLS // max(1, sum(m.coef.size for m in models if m.variant == names[0])))
    given = rows.select(F.col(fold).cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    parts = []
    for i in range(0, len(names), each):
        some = names[i : i + each]
        held = {f: (np.column_stack([m.coef[:, 0] for m in models if m.fold == f and m.variant in some]), np.array([m.intercept[0] for m in models if m.fold == f and m.variant in some])) for f in {m.fold for m in models}}

        def run(batches: Iterator[pa.RecordBatch], held=held, some=some) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                truth, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
                for f in np.unique(folds):
                    own = folds == f
                    coef, intercept = held[int(f)]
                    e = m[own] @ coef + intercept - truth[own, None]
                    n = len(e)
                    new = np.stack([np.full(len(some), n), (e * e).sum(0), np.abs(e).sum(0), np.full(len(some), truth[own].sum()), np.full(len(some), np.square(truth[own]).sum())])
                    sums[int(f)] = sums.get(int(f), 0) + new
            for f, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([f] * len(some), pa.int32()), pa.array(s[0].astype(np.int64)), *(pa.array(s[j]) for j in range(1, 5))], names=["variant_id", "fold", "n", "ee", "ae", "y", "yy"])

        parts.append(given.mapInArrow(run, "variant_id string, fold int, n bigint, ee double, ae double, y double, yy double"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    label = F.concat(F.lit("fold"), F.col("fold").cast("string"))
    summed = every.groupingSets([["variant_id", "fold"], ["variant_id"]], "variant_id", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "ee", "ae", "y", "yy")])
    total = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return summed.select(
        "variant_id", F.coalesce(label, F.lit("avg")).alias("fold_id"), "n", (F.col("ee") / F.col("n")).alias("mse"), F.sqrt(F.col("ee") / F.col("n")).alias("rmse"), (F.col("ae") / F.col("n")).alias("mae"),
        F.when(total > 0, 1 - F.col("ee") / F.nullif(total, F.lit(0.0))).otherwise(F.when(F.col("ee") == 0, 1.0).otherwise(0.0)).alias("r2"),
    )


def select_by_cv(scores: DataFrame, variants: list[str], metric: str = "rmse", lower_is_better: bool = True, producer: str | None = None) -> list[tuple[int, str, float]]:
    """(rank, variant, value) by the pooled score of each variant's out-of-fold rows, best first, ties by name.

    All or none: if some variants have a finite score and others don't, ranking would be unfair and is refused; if none
    has, the result is empty. ``scores`` may have a column ``producer``; scores of several producers are ambiguous unless
    one is named. A variant that isn't among ``variants`` and a repeated score are refused. There is one row per variant.
    """
    rows = scores.where("fold_id = 'avg'")
    if "producer" in scores.columns:
        if producer is not None:
            rows = rows.where(F.col("producer") == producer)
        else:
            many = [r[0] for r in rows.select("producer").distinct().limit(2).collect()]
            if len(many) > 1:
                raise CampaignValidation(f"ambiguous: several producers have scores ({', '.join(sorted(map(str, many)))}, ...); name the one to select by")
    found = [(r[0], r[1]) for r in rows.select("variant_id", F.col(metric)).collect()]
    names = [v for v, _ in found]
    if len(set(names)) < len(names) or set(names) - set(variants):
        raise CampaignValidation("scores of unknown or repeated variants")
    good = {v: s for v, s in found if s is not None and np.isfinite(s)}
    if not good:
        return []
    lone = sorted(set(variants) - set(good))
    if lone:
        raise CampaignValidation(f"{len(lone)} of {len(set(variants))} variants have no score: {lone[:5]}")
    order = sorted(good, key=lambda v: (good[v] if lower_is_better else -good[v], v))
    return [(i + 1, v, good[v]) for i, v in enumerate(order)]


def stack(predictions: DataFrame, rows: DataFrame, columns: list[tuple[str, str]], resampled: bool = False, name: str = "x") -> DataFrame:
    """``rows`` (one for each sample) with the array ``name``: the out-of-fold prediction of each (producer, target) of ``columns``.

    Fails closed while it runs: a sample without a prediction, one predicted twice (unless ``resampled``, where repeats are
    averaged), a value that isn't finite, and rows that aren't of a validation partition. Predictions of other producers
    and targets aren't read. One aggregation and one join by sample.
    """
    picked = lambda p, t: (F.col("producer") == p) & (F.col("target") == t)
    aggs = []
    for i, (p, t) in enumerate(columns):
        aggs += [F.avg(F.when(picked(p, t), F.col("value"))).alias(f"v{i}"), F.count_if(picked(p, t)).alias(f"n{i}"), F.count_if(picked(p, t) & (F.col("partition") != "validation")).alias(f"l{i}")]
    wide = predictions.groupBy("sample_id").agg(*aggs)
    refuse = lambda code, what, p, t: F.raise_error(F.concat(F.lit(f"{code}: {p}.{t} {what}: "), F.col("sample_id").cast("string"))).cast("double")
    cells = []
    for i, (p, t) in enumerate(columns):
        v, n = F.col(f"v{i}"), F.coalesce(f"n{i}", F.lit(0))
        cell = F.when(F.col(f"l{i}") > 0, refuse("oof_leakage", "has a block that isn't of a validation partition", p, t)).when(n == 0, refuse("oof_validation", "has no prediction for", p, t))
        if not resampled:
            cell = cell.when(n > 1, refuse("oof_validation", "predicts twice", p, t))
        cells.append(cell.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), refuse("oof_validation", "has no finite value for", p, t)).otherwise(v))
    joined = rows.join(wide, "sample_id", "left")
    return joined.withColumn(name, F.array(*cells)).drop(*[f"{c}{i}" for i in range(len(columns)) for c in "vnl"])


def pls_da(rows: DataFrame, x: str, label: str, components: int, fold: str = "fold") -> DataFrame:
    """``rows`` with ``predicted``: the label whose indicator partial least squares predicts highest out of fold, ties by label.

    Labels are few: their indicators are columns of the model, at most MAX_DIMS with the features. A null label is refused.
    """
    labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_DIMS + 1).collect())
    if len(labels) > MAX_DIMS:
        raise ValueError(f"more than {MAX_DIMS} labels")
    names = [f"__p{i}" for i in range(len(labels))]
    shown = rows.withColumns({f"__y{i}": (F.col(label) == v).cast("double") for i, v in enumerate(labels)})
    moments = fold_moments(shown, x, [f"__y{i}" for i in range(len(labels))], fold)
    out = predict(rows, fit_folds(moments, simpls(components)), x, names, fold)
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("p"), F.lit(-i).alias("i")) for i, n in enumerate(names)]))["i"]
    return out.withColumn("predicted", F.get(F.array(*[F.lit(v) for v in labels]), -best)).drop(*names)


def selected_features(moments: FoldMoments, keep: int) -> list[tuple[int, list[float], list[bool]]]:
    """(fold, scores, mask): the squared correlation of each feature with the target on a fold's train rows, and the ``keep`` best.

    The validation rows of a fold have no part in its mask; ties go to the earlier feature; a constant feature scores 0.
    The fold ALL is the selection of a refit.
    """
    out = []
    for f in [*sorted(moments.own), *([] if moments.trained else [ALL])]:
        m = moments.train(f)
        spread = np.diag(m.xx) * m.yy[0, 0]
        score = np.divide(m.xy[:, 0] ** 2, spread, out=np.zeros(len(m.xx)), where=spread > 0)
        best = np.lexsort((np.arange(len(score)), -score))[:keep]
        out.append((f, score.tolist(), np.isin(np.arange(len(score)), best).tolist()))
    return out


def masked(fit: Callable[[list[int]], Fit], moments: FoldMoments, keep: int) -> list[Model]:
    """One model for each fold on the features that the fold's own train rows select, by ``fit`` of the kept columns."""
    out = []
    for f, _, mask in selected_features(moments, keep):
        m = moments.train(f)
        coef = fit([i for i, k in enumerate(mask) if k])(m)
        out.append(Model(f"top{keep}", f, coef, m.y_mean - m.x_mean @ coef))
    return out

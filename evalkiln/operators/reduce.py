"""Reducers over repetitions, folds and branches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Share trimmed at each end by the robust mean; a constant of the method.
TRIM = 0.1
#: Fixed value: rows with a larger T² are outliers.
OUTLIER_T2 = 5.023886
#: The distance from 1 to the next double: a smaller variance of the other rows is none.
EPSILON = 2.220446049250313e-16


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Null where the weights sum to nothing; ``zero_weights`` lists those units."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))


def vote(value: str) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(F.col(value), True)


def robust_mean(value: str) -> Column:
    """The mean without the lowest and the highest tenth: floor(n / 10) values at each end, at most (n - 1) / 2."""
    values = F.array_sort(F.collect_list(value))

    def trimmed(v: Column) -> Column:
        cut = F.least(F.floor(F.size(v) * TRIM).cast("int"), F.floor((F.size(v) - 1) / 2).cast("int"))
        kept = F.slice(v, cut + 1, F.size(v) - 2 * cut)
        return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)

    return F.transform(F.array(values), trimmed)[0]


REDUCERS: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "median": F.median, "vote": vote, "robust_mean": robust_mean,
}


def reduce_units(rows: DataFrame, keys: list[str], values: list[str], method: str, weight: str | None = None) -> DataFrame:
    """One row per unit; ``method`` is mean, weighted_mean, median, vote, robust_mean or none."""
    if method == "weighted_mean":
        return rows.groupBy(*keys).agg(*[weighted_mean(v, weight).alias(v) for v in values], F.count("*").alias("n"))
    if method == "none":
        return rows.groupBy(*keys).agg(*[F.first(v).alias(v) for v in values], F.count("*").alias("n"))
    return rows.groupBy(*keys).agg(*[REDUCERS[method](v).alias(v) for v in values], F.count("*").alias("n"))


def exclude_outliers(rows: DataFrame, keys: list[str], values: list[str], threshold: float = OUTLIER_T2, least_variance: float = EPSILON) -> DataFrame:
    """The mean without outlying rows of a unit.

    A row's T² is the sum over all values of its squared distance from the mean of the other rows over their
    (population) variance; it is dropped above ``threshold``, with all its values. A value whose variance among the others
    is at most ``least_variance`` adds nothing. Units of fewer than three rows, or where all rows would go, keep their
    plain mean.

    The mean and variance of the others follow from those of the whole unit and the row itself, so nothing of a unit is
    held: with d the distance from the unit's mean and Q the sum of its squares, the others lie at d n / (n - 1) and have
    the variance (Q - d² n / (n - 1)) / (n - 1). Others that are all equal, which a difference of sums can't tell, are
    known by how often the least and the greatest value stand in the unit. Two aggregations by unit and one after them.
    """
    v = [F.col(x).cast("double").alias(f"__v{i}") for i, x in enumerate(values)]
    given = rows.select(*keys, *v)
    ends = given.groupBy(*keys).agg(F.count("*").alias("__n"), *[f(f"__v{i}").alias(f"__{name}{i}") for i in range(len(values)) for name, f in (("mean", F.avg), ("var", F.var_pop), ("low", F.min), ("high", F.max))])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    with_ends = lambda df, stats: df.join(stats.withColumnsRenamed({k: f"__k_{k}" for k in keys}), same).drop(*[f"__k_{k}" for k in keys])
    placed = with_ends(given, ends)
    often = placed.groupBy(*keys).agg(*[F.count_if(F.col(f"__v{i}") == F.col(f"__{name}{i}")).alias(f"__n_{name}{i}") for i in range(len(values)) for name in ("low", "high")])
    placed = with_ends(placed, often)
    n = F.col("__n")
    t2 = F.lit(0.0)
    for i in range(len(values)):
        x, low, high = F.col(f"__v{i}"), F.col(f"__low{i}"), F.col(f"__high{i}")
        d = x - F.col(f"__mean{i}")
        far = d * d * n * n / ((n - 1) * (n - 1))
        spread = (F.col(f"__var{i}") * n - d * d * n / (n - 1)) / (n - 1)
        constant = (low == high) | ((x == high) & (F.col(f"__n_low{i}") == n - 1)) | ((x == low) & (F.col(f"__n_high{i}") == n - 1))
        # others closer together than the digits of the row's own distance show: the row is infinitely far from them
        t2 = t2 + F.when(constant, 0.0).when(spread > F.greatest(F.lit(least_variance), 1e-13 * d * d), far / F.nullif(spread, F.lit(0.0))).when(1e-13 * d * d > least_variance, float("inf")).otherwise(0.0)
    fine = F.when(n < 3, F.lit(True)).otherwise(t2 <= threshold)
    sums = placed.select(*keys, "__n", *[f"__v{i}" for i in range(len(values))], fine.alias("__fine")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("__fine").alias("__used"), *[F.avg(F.when(F.col("__fine"), F.col(f"__v{i}"))).alias(f"__fine{i}") for i in range(len(values))], *[F.avg(f"__v{i}").alias(f"__all{i}") for i in range(len(values))]
    )
    some = F.col("__used") > 0
    return sums.select(*keys, *[F.when(some, F.col(f"__fine{i}")).otherwise(F.col(f"__all{i}")).alias(x) for i, x in enumerate(values)], "n", F.when(some, F.col("__used")).otherwise(F.col("n")).alias("n_used"))


def custom_reduce(rows: DataFrame, keys: list[str], value: str, fn: Callable[[pd.Series], float]) -> DataFrame:
    """A reducer in Python, called once per unit with its values; one unit has to fit in a task.

    Units are gathered by Spark and go to Python many at a time, so a small unit costs its call and not a frame of its own.
    Nulls are NaN there and count as rows.
    """

    @F.pandas_udf("double")
    def run(units: pd.Series) -> pd.Series:
        return pd.Series([float(fn(pd.Series(x, dtype=None if len(x) else "float64"))) for x in units])

    # as structs, since a list of bare values leaves out nulls
    units = rows.select(*keys, value).groupBy(*keys).agg(F.collect_list(F.struct(value)).alias("__values"))
    return units.select(*keys, run(F.transform("__values", lambda x: x[value])).alias(value), F.size("__values").cast("bigint").alias("n"))


def fuse_branches(rows: DataFrame, weights: dict[str, float] | None = None, branch_col: str = "branch") -> DataFrame:
    """Late fusion: the (weighted) mean of the branches that cover a sample; the denominator is theirs alone."""
    if weights is None:
        return rows.groupBy("sample_id", "target").agg(F.avg("value").alias("value"), F.count("*").alias("n_branches"))
    w = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(branch_col))
    return rows.withColumn("__w", w).groupBy("sample_id", "target").agg(weighted_mean("value", "__w").alias("value"), F.count("*").alias("n_branches"))


def fuse_probabilities(rows: DataFrame, unit: str, class_col: str, branch_col: str = "branch") -> DataFrame:
    """The mean of class probabilities over branches, normalised again."""
    mean = rows.groupBy(unit, class_col).agg(F.sum("p").alias("s")).join(rows.groupBy(unit).agg(F.count_distinct(branch_col).alias("n")), unit)
    mean = mean.withColumn("p", F.col("s") / F.col("n"))
    return mean.select(unit, class_col, (F.col("p") / F.sum("p").over(Window.partitionBy(unit))).alias("p"))


def probability_violations(rows: DataFrame, unit: str, branch_col: str = "branch") -> DataFrame:
    """Rows of probabilities that are negative, don't sum to 1 or have fewer than two classes."""
    per = rows.groupBy(branch_col, unit).agg(F.sum("p").alias("total"), F.min("p").alias("least"), F.count("*").alias("n"))
    return per.where((F.col("least") < 0) | (F.abs(F.col("total") - 1) > 1e-6) | (F.col("n") < 2)).select(branch_col, unit)

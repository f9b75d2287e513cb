"""Relational models that a fold trains: no fold is materialised, train is the total minus the fold's own part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(18,2)"
#: Rows of a model (keys times folds) that may be broadcast.
SMALL_MODEL = 20_000


def loo_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, fold, <name>_train, n_train): sums over all other folds by total minus own part; exact for decimals."""
    part = rows.groupBy(*keys, "fold").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("*").alias("n"))
    total = part.groupBy(*keys).agg(*[F.sum(n).alias(f"t_{n}") for n in sums], F.sum("n").alias("t_n")) if keys else part.agg(*[F.sum(n).alias(f"t_{n}") for n in sums], F.sum("n").alias("t_n"))
    joined = part.join(total, keys) if keys else part.crossJoin(F.broadcast(total))
    return joined.select(*keys, "fold", *[(F.col(f"t_{n}") - F.col(n)).alias(f"{n}_train") for n in sums], (F.col("t_n") - F.col("n")).alias("n_train"))


def group_mean_oof(rows: DataFrame, key: str, y: str = "y") -> DataFrame:
    """Out-of-fold predictions of the mean of y by key, learned on the other folds; null where they lack the key.

    A model of few keys is broadcast, so no key's rows meet in one task.
    """
    m = loo_sums(rows, [key], {"s": F.col(y).cast(MONEY)})
    p = F.col("s_train").cast("double") / F.nullif(F.col("n_train").cast("double"), F.lit(0.0))
    m = m.select(key, "fold", p.alias("value"))
    few = m.limit(SMALL_MODEL + 1).count() <= SMALL_MODEL
    return rows.join(F.broadcast(m) if few else m, [key, "fold"])


def linear_oof(rows: DataFrame, x: str, y: str = "y", ridge: float = 0.0) -> DataFrame:
    """Out-of-fold predictions of a line y = a + b x by the normal equations of the other folds."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    m = loo_sums(rows, [], {"sx": xs, "sy": ys, "sxx": xs * xs, "sxy": xs * ys})
    n = F.col("n_train").cast("double")
    slope = (F.col("sxy_train") - F.col("sx_train") * F.col("sy_train") / n) / (F.col("sxx_train") - F.col("sx_train") * F.col("sx_train") / n + F.lit(float(ridge)))
    m = m.withColumn("b", slope).withColumn("a", (F.col("sy_train") - slope * F.col("sx_train")) / n)
    return rows.join(F.broadcast(m.select("fold", "a", "b")), "fold").withColumn("value", F.col("a") + F.col("b") * xs).drop("a", "b")


def target_zscore(rows: DataFrame, y: str = "y") -> DataFrame:
    """y scaled by the mean and deviation of the other folds, with what inverts it: y_scaled, mean_train, sd_train."""
    v = F.col(y).cast("double")
    m = loo_sums(rows, [], {"s": v, "ss": v * v})
    mean = F.col("s_train") / F.col("n_train")
    m = m.select("fold", mean.alias("mean_train"), F.sqrt((F.col("ss_train") - F.col("s_train") * mean) / (F.col("n_train") - 1)).alias("sd_train"))
    return rows.join(F.broadcast(m), "fold").withColumn("y_scaled", F.when(F.col("sd_train") > 0, (v - F.col("mean_train")) / F.nullif("sd_train", F.lit(0.0))).otherwise(0.0))


def augment_train(rows: DataFrame, fold: int, copies: int, column: str, scale: float) -> DataFrame:
    """Train rows of a fold with perturbed copies that keep their origin; validation rows are never copied."""
    base = rows.withColumn("is_augmented", F.lit(False)).withColumn("origin_sample_id", F.col("sample_id"))
    more = base.where(F.col("fold") != fold).withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    more = more.withColumn(column, F.col(column) * (1 + F.col("__c") * F.lit(scale))).withColumn("sample_id", F.concat("sample_id", F.lit(".a"), F.col("__c").cast("string"))).withColumn("is_augmented", F.lit(True)).drop("__c")
    return base.unionByName(more)

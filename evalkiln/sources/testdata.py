"""The test tables in the roles of the engine: samples, observations, folds, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evalkiln.operators import folds
from evalkiln.sources.stores import reread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_id(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 9, "0"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: identity, groups, regression target y, its logarithm ly and class label."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        sample_id("o_orderkey").alias("sample_id"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("target_id"),
        F.concat(F.lit("G"), F.col("c_nationkey").cast("string")).alias("group_id"), F.col("o_totalprice").alias("y"), F.ln("o_totalprice").alias("ly"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: an observation of its order, with source, repetition, weight and measured values v (a logarithm) and q."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").withColumn("rep", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    own = lines.select(
        sample_id("l_orderkey").alias("sample_id"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("rep").cast("string")).alias("observation_id"),
        F.col("l_returnflag").alias("source_id"), F.col("rep"), F.concat(F.lit("R"), F.col("rep").cast("string")).alias("rep_id"),
        (1 - F.col("l_discount")).alias("weight"), (F.col("l_tax") == 0.08).alias("excluded"), F.col("l_linestatus").alias("status"),
        F.ln(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"),
        F.array(F.col("l_linestatus"), F.when(F.col("l_quantity") > 25, "bulk").otherwise("small")).alias("tags"),
    )
    meta = samples(spark, sf_dir).select("sample_id", "target_id", "group_id", "priority", "y")
    return own.join(meta, "sample_id")


def fold_of(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(sample_id, fold) of the unshuffled K-fold over all samples."""
    return folds.kfold(samples(spark, sf_dir).select("sample_id"), k)


def folded(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """``samples`` with their fold, placed once and kept in the shared folder: every later pass is a scan."""
    return reread(folds.with_fold(samples(spark, sf_dir), k), [])


def membership(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return folds.membership(fold_of(spark, sf_dir, k), k)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of two producers for the logarithm of y, one row per sample, fold and producer."""
    return predicted(folds.with_fold(samples(spark, sf_dir), 5))


def predicted(s: DataFrame) -> DataFrame:
    """``predictions`` of samples with their fold."""
    a = F.col("ly") * (1 + ((F.col("c") % 7) - 3) / 20.0)
    b = F.col("ly") * (1 + ((F.col("k") % 5) - 2) / 10.0)
    rows = s.select("sample_id", "fold", F.col("ly").alias("y"), "group_id", "target_id", F.explode(F.array(F.struct(F.lit("m:a").alias("producer"), a.alias("value")), F.struct(F.lit("m:b").alias("producer"), b.alias("value")))).alias("p"))
    return rows.select(F.col("p.producer").alias("producer"), F.lit("validation").alias("partition"), F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("fold_id"), "sample_id", "target_id", "group_id", F.lit("y").alias("target"), F.col("p.value").alias("value"), "y")

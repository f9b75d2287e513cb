"""Time the headline queries on $BENCH_SF_DIR with $BENCH_CPUS threads; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

HEADLINE = (
    "oof_campaign", "oof_join_wide", "oof_coverage_report", "split_kfold_shuffled", "split_group", "agg_obs_mean", "agg_exclude_outliers", "agg_median",
    "metric_report_long", "metric_cross_fold_avg", "select_variant", "conformal_metrics", "chain_rank_by_dataset", "combo_cartesian", "fusion_dict", "robust_slices", "stacked_meta_model",
)


def probe(spark: SparkSession) -> DataFrame:
    """The out-of-fold join of 12,000 samples, 4 producers, 6 folds and 2 targets: 12,000 rows of 8 columns; all 96,000 values are checked."""
    from pyspark.sql import functions as F

    from evalkiln.operators.predictions import oof_campaign

    s = spark.range(12_000).select(F.format_string("S%05d", "id").alias("sample_id"), "id", (F.col("id") % 6).alias("f"))
    fold = lambda c: F.concat(F.lit("fold"), c.cast("string"))
    rows = s.select("sample_id", F.lit("validation").alias("partition"), fold(F.col("f")).alias("fold_id"), F.explode(F.array(*[F.lit(f"p{i}") for i in range(4)])).alias("producer"), "id")
    values = rows.select("*", F.explode(F.array(F.lit("t0"), F.lit("t1"))).alias("target")).withColumn("value", F.substring("producer", 2, 1).cast("double") + F.col("id"))
    every = s.select("sample_id", "f", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("g"))
    members = every.select("sample_id", fold(F.col("g")).alias("fold_id"), F.when(F.col("f") == F.col("g"), "validation").otherwise("train").alias("role"))
    return oof_campaign(values, members, s, [(f"p{i}", t) for i in range(4) for t in ("t0", "t1")])


def main() -> None:
    from evalkiln.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["oof_probe_48k"] = lambda s, d: probe(s)
    took: dict[str, float] = {}
    for warm in (True, False):
        for name in (*HEADLINE, "oof_probe_48k"):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if not warm:
                took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

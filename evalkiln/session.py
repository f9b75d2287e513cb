"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "evalkiln", **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI arithmetic and adaptive execution; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


#: Rows that one task of a shuffle should take, the bytes up to which small partitions are read together, and those from
#: which a partition far above the others is read by several tasks of a join.
TASK_ROWS, TASK_BYTES, SKEWED_BYTES = 250_000, "1MB", "4MB"


def spread(spark: SparkSession, rows: int) -> None:
    """Let the shuffles of a session have a partition for each TASK_ROWS of ``rows``, where they have fewer.

    So a task's memory stays the same when tables grow. Partitions are joined again up to TASK_BYTES only: rows with
    running ids are packed to a few bytes each, so that a partition of the usual 64 MB would hold very many of them, and one of the usual 256 MB is late to be called skewed.
    """
    if rows > TASK_ROWS:
        least = -(-rows // TASK_ROWS)
        spark.conf.set("spark.sql.shuffle.partitions", str(max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", SKEWED_BYTES)

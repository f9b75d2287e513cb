"""What the operators of this subpackage share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows in one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch, where Spark knows the setting.
BATCH_BYTES = 16 << 20
#: Characters of a plan that the driver keeps as text; literals such as a rank map are long.
PLAN_TEXT = 1 << 13


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, by rows and by bytes, and the plans' texts on the driver."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))


def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches that have rows: columns of an empty frame have no type that Arrow could keep."""
    return (b for b in batches if len(b))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="evalkiln-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: dict[str, SparkSession] = {}
#: The catalog's names of bucketed tables, by path.
_names: dict[str, str] = {}
#: Where the tables that ``written`` gave are.
_place: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
    _delete(spark, path)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before the interpreter; the next path may have another session
            continue


atexit.register(_clean)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/evalkiln-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    The table survives lost executors. It is removed by ``release``, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _place[out] = path
    return out


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``written``, in buckets of ``by``: later joins on that column don't shuffle these rows again.

    ``df`` is grouped by that column already, so a task writes few buckets.
    """
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"evalkiln_{uuid.uuid4().hex}"
    _names[path] = table
    df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    _place[out] = path
    return out


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, between the steps of a long computation.

    Only so does Spark learn which shuffles and broadcasts no one needs any more and removes their files, and the plans of
    many small jobs don't pile up in the driver's heap.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Remove tables that ``written`` or ``bucketed`` gave and that no later action reads, and ``tidy``."""
    spark = None
    for df in tables:
        path = _place.pop(df)
        spark = _written.pop(path)
        _remove(spark, path)
    if spark is not None:
        tidy(spark)


def carried(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(kept, __text): the columns to keep as one struct, so that no name can clash, and the text once."""
    rest = [c for c in keep if c != text_col]
    return docs.select(F.struct(*rest).alias("kept") if rest else F.lit(None).cast("int").alias("kept"), F.col(text_col).alias("__text"))


def restored(df: DataFrame, text_col: str, keep: list[str], *more: str) -> DataFrame:
    """The kept columns in their order, and ``more``; the inverse of ``carried``."""
    return df.select(*[F.col("__text").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in keep], *more)


#: A key with more than one row in so many is joined by broadcast; there can be no more such keys than this.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, sort: bool = False) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row for each key and in ``count`` how many rows have it.

    Keys that hold over a thousandth of all rows are at most HOT, so their groups may be broadcast; no other key can
    fill a task. Keys are not null. The column ``count`` is not part of the result. ``sort``: the other groups are joined by
    sorting, also where Spark takes them to be small.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT > F.lit(total)
    hot = groups.where(is_hot).drop(count)
    rest = groups.where(~is_hot).drop(count)
    with_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge") if sort else rest, key, "left")
    return with_hot.unionByName(others)

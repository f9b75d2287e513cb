"""Stores of predictions and their forms: Parquet caches, JSON documents, flat tensors, provenance."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evalkiln.checks import CampaignValidation, strict
from evalkiln.functions.hashing import table_fingerprint


def write_cache(predictions: DataFrame, path: str, partition_by: list[str]) -> None:
    """Parquet, partitioned so that a reader of one producer and fold opens only its files."""
    predictions.write.partitionBy(*partition_by).parquet(path)


def read_cache(spark, path: str, schema: T.StructType, producer: str | None = None) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    return found.where(F.col("producer") == producer) if producer else found


def reread(predictions: DataFrame, partition_by: list[str]) -> DataFrame:
    """Write a cache to a new path in the shared checkpoint folder and read it again."""
    spark = predictions.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="evalkiln-")
    path = f"{base}/cache-{uuid.uuid4().hex}"
    write_cache(predictions, path, partition_by)
    return read_cache(spark, path, predictions.schema)


def verified(cache: DataFrame, fingerprint: str) -> DataFrame:
    """``cache`` if its content has the recorded fingerprint; else an error."""
    if table_fingerprint(cache).first()["fingerprint"] != fingerprint:
        raise ValueError("the cache's content doesn't match its fingerprint")
    return cache


def to_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, payload_json): each row as a block with a JSON payload."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.to_json(F.struct(*rest)).alias("payload_json"))


def from_json(blocks: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    rest = T.StructType([f for f in schema if f.name not in keys])
    return blocks.select(*keys, F.from_json("payload_json", rest).alias("p")).select(*keys, "p.*").select(*schema.names)


def tensor(rows: DataFrame, index: str, vector: str, width: int, row_major: bool) -> DataFrame:
    """(position, value) of a matrix whose rows are numbered from 0 by ``index``."""
    cells = rows.select(F.col(index).alias("i"), F.posexplode(vector).alias("j", "x"))
    if row_major:
        return cells.select((F.col("i") * width + F.col("j")).alias("position"), F.col("x").cast("double").alias("value"))
    height = F.broadcast(rows.agg(F.count("*").alias("h")))  # one row
    return cells.crossJoin(height).select((F.col("j") * F.col("h") + F.col("i")).alias("position"), F.col("x").cast("double").alias("value"))


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def provenance(predictions: DataFrame) -> DataFrame:
    """(id, kind, json): linked documents of what a campaign made, in the terms of research-object crates.

    A ``Dataset`` for each block with its rows and the first and last sample, and a ``CreateAction`` for each producer
    with its blocks as results, in order. One aggregation by block, one over the blocks.
    """
    blocks = predictions.groupBy("producer", "fold_id").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"), F.max("sample_id").alias("last"))
    blocks = blocks.withColumn("id", F.concat_ws(":", F.lit("block"), "producer", "fold_id"))
    data = F.to_json(F.struct(F.col("id").alias("@id"), F.lit("Dataset").alias("@type"), "n", "first", "last"))
    runs = blocks.groupBy("producer").agg(F.array_sort(F.collect_list("id")).alias("result")).withColumn("id", F.concat_ws(":", F.lit("run"), "producer"))
    action = F.to_json(F.struct(F.col("id").alias("@id"), F.lit("CreateAction").alias("@type"), "result"))
    return blocks.select("id", F.lit("Dataset").alias("kind"), data.alias("json")).unionByName(runs.select("id", F.lit("CreateAction").alias("kind"), action.alias("json")))


# --- prediction blocks as Arrow streams

#: Rows of one stream; a block of more is several streams, so no block has to fit in a task.
STREAM_ROWS = 100_000


def to_arrow(predictions: DataFrame, block: list[str], rows: int = STREAM_ROWS) -> DataFrame:
    """(block columns, rows, sha256, stream): each block as Arrow IPC streams, its identity in the schema's metadata.

    A task writes what it reads of each block, in the order in which it comes, so nothing is shuffled and a block that
    holds most rows is as many streams as it needs. ``from_arrow`` is the inverse, in no order. Columns keep their types
    and nulls; an empty table gives no stream.
    """
    import pyarrow as pa

    rest = [c for c in predictions.columns if c not in block]
    given = predictions.select(*[F.col(c).cast("string").alias(c) for c in block], *rest)
    fields = ", ".join(f"{c} string" for c in block)

    def run(batches):
        def stream(key, table):
            named = table.replace_schema_metadata({f"block.{c}": v if v is not None else "" for c, v in zip(block, key)} | {"block.null": ",".join(c for c, v in zip(block, key) if v is None)})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, named.schema) as writer:
                writer.write_table(named)
            held = out.getvalue().to_pybytes()
            columns = [*[pa.array([v], pa.string()) for v in key], pa.array([table.num_rows], pa.int64()), pa.array([hashlib.sha256(held).hexdigest()]), pa.array([held], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*block, "rows", "sha256", "stream"])

        waiting: dict[tuple, list] = {}
        held = 0
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in block]))
            for key in dict.fromkeys(keys):
                part = batch.filter(pa.array([k == key for k in keys])).select(rest)
                waiting.setdefault(key, []).append(part)
                held += part.num_rows
            while held >= rows:  # what is largest goes first, so that streams aren't small
                key = max(waiting, key=lambda k: sum(p.num_rows for p in waiting[k]))
                table = pa.Table.from_batches(waiting.pop(key))
                held -= table.num_rows
                for at in range(0, table.num_rows, rows):
                    yield stream(key, table.slice(at, rows))
        for key, parts in waiting.items():
            yield stream(key, pa.Table.from_batches(parts))

    return given.mapInArrow(run, f"{fields}, rows bigint, sha256 string, stream binary")


def from_arrow(streams: DataFrame, schema: T.StructType, block: list[str]) -> DataFrame:
    """The rows of ``to_arrow``; a stream whose digest, identity or columns don't fit raises in the task that reads it."""
    import pyarrow as pa

    rest = [f.name for f in schema if f.name not in block]
    out = ", ".join([*[f"{c} string" for c in block], *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in block]])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if hashlib.sha256(row["stream"]).hexdigest() != row["sha256"]:
                    raise ValueError("validation: a stream was changed")
                table = pa.ipc.open_stream(row["stream"]).read_all()
                said = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}
                null = said.get("block.null", "").split(",")
                if any((None if c in null else said.get(f"block.{c}")) != row[c] for c in block) or table.num_rows != row["rows"] or table.column_names != rest:
                    raise ValueError("validation: a stream isn't that of its block")
                for part in table.to_batches():
                    names = [pa.array([row[c]] * part.num_rows, pa.string()) for c in block]
                    yield pa.RecordBatch.from_arrays([*names, *part.columns], names=[*block, *rest])

    read = streams.select(*block, "rows", "sha256", "stream").mapInArrow(run, out)
    return read.select(*[F.col(f.name).cast(f.dataType) for f in schema])


# --- artifacts by content

#: A relative address below its root: no scheme, no drive, no step upwards.
ADDRESS = r"^(?!.*(?:^|/)\.\.?(?:/|$))[^/:\\][^:\\]*$"


def _address(root: str, spark) -> Column:
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    return F.substring(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), F.lit(len(base) + 2), F.length("path")).alias("address")


def artifacts(spark, root: str, glob: str = "*") -> DataFrame:
    """(address, size, sha256) of the files under ``root``: addresses are relative to it, so a register can move with its files.

    Files are read and digested by the tasks; their contents don't leave them. An empty file is no artifact.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select(_address(root, spark), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def refetch_violations(register: DataFrame, found: DataFrame) -> DataFrame:
    """(address, problem): what forbids the use of registered artifacts, given what is found under their root now.

    ``address`` (absolute, with a scheme, or leaving the root), ``repeated`` (registered twice), ``missing`` and
    ``changed`` (another size or digest). What is found but not registered doesn't matter.
    """
    bad = register.where(F.col("address").isNull() | ~F.col("address").rlike(ADDRESS)).select("address", F.lit("address").alias("problem"))
    twice = register.groupBy("address").count().where("count > 1").select("address", F.lit("repeated").alias("problem"))
    both = register.select("address", "size", "sha256").join(found.select("address", F.col("size").alias("__size"), F.col("sha256").alias("__sha256")), "address", "left")
    problem = F.when(F.col("__sha256").isNull(), "missing").when((F.col("size") != F.col("__size")) | (F.col("sha256") != F.col("__sha256")), "changed")
    return bad.unionByName(twice).unionByName(both.select("address", problem.alias("problem")).where("problem is not null"))


def refetch(spark, root: str, register: DataFrame) -> DataFrame:
    """(address, content) of the registered files; refuses before anything is handed out if any was changed or is missing."""
    strict(refetch_violations(register, artifacts(spark, root)), CampaignValidation, "artifacts that aren't what was registered")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_address(root, spark), "content").join(register.select("address"), "address", "left_semi")

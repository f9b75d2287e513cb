import datetime
import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from evalkiln.checks import CampaignValidation
from evalkiln.sources import stores

SCHEMA = "producer string, fold int, sample_id string, value double, extra array<int>, at timestamp"


def blocks(spark):
    now = datetime.datetime(2024, 5, 1, 12)
    rows = [(["a", "b", None][i % 3], i % 2, f"s{i}", float(i) if i % 7 else None, [i, None] if i % 5 else None, now) for i in range(500)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("rows", [7, 100_000])
def test_arrow_roundtrip(spark, rows):
    """Types, nulls and null block keys come back; a small limit makes many streams of one block."""
    given, df = blocks(spark)
    held = stores.to_arrow(df, ["producer", "fold"], rows)
    assert held.agg(F.sum("rows")).first()[0] == 500 and (held.count() > 30) == (rows == 7)
    back = stores.from_arrow(held, df.schema, ["producer", "fold"])
    assert [f.simpleString() for f in back.schema] == [f.simpleString() for f in df.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert stores.to_arrow(df.limit(0), ["producer", "fold"]).count() == 0


def test_changed_streams_are_refused(spark):
    _, df = blocks(spark)
    held = stores.to_arrow(df.where("producer is not null"), ["producer", "fold"])
    for bad in (held.withColumn("sha256", F.lit("0")), held.withColumn("producer", F.lit("c")), held.withColumn("rows", F.col("rows") + 1), held.withColumn("stream", F.concat("stream", F.lit(b"x")))):
        with pytest.raises(Exception, match="validation: a stream"):
            stores.from_arrow(bad, df.schema, ["producer", "fold"]).collect()


def test_artifacts(spark, tmp_path):
    root = tmp_path / "models"
    (root / "deep").mkdir(parents=True)
    (root / "a.bin").write_bytes(b"weights")
    (root / "deep" / "b c.bin").write_bytes(b"x")
    register = stores.artifacts(spark, str(root))
    rows = {r.address: (r.size, r.sha256) for r in register.collect()}
    assert rows == {"a.bin": (7, hashlib.sha256(b"weights").hexdigest()), "deep/b c.bin": (1, hashlib.sha256(b"x").hexdigest())}
    kept = spark.createDataFrame([(a, *x) for a, x in rows.items()], register.schema)
    moved = tmp_path / "elsewhere"
    shutil.copytree(root, moved)
    assert {r.address: bytes(r.content) for r in stores.refetch(spark, f"file://{moved}", kept).collect()} == {"a.bin": b"weights", "deep/b c.bin": b"x"}
    (moved / "a.bin").write_bytes(b"Weights")
    with pytest.raises(CampaignValidation, match="changed"):
        stores.refetch(spark, str(moved), kept)
    (moved / "a.bin").unlink()
    with pytest.raises(CampaignValidation, match="missing"):
        stores.refetch(spark, str(moved), kept)


def test_addresses(spark):
    good, bad = ["a", "a/b", "a/..b", ".hidden/x", "..a"], ["/a", "../a", "a/../b", "a/..", "./a", "file:a", "c:\\x", "a\\b", "", None]
    df = spark.createDataFrame([(a, 1, "x") for a in good + bad], "address string, size bigint, sha256 string")
    found = {r.address for r in stores.refetch_violations(df, df).where("problem = 'address'").collect()}
    assert found == set(bad)

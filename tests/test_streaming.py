import duckdb
from pyspark.sql import functions as F

from evalkiln.streaming.scores import windowed_scores

EVENTS = "/root/testdata/sf0.001/events.parquet"


def prepared(df):
    return df.select("ts", F.col("event_type").alias("producer"), "value", F.lit(10.0).alias("y"))


def test_stream_equals_table_and_sql(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "events.parquet").symlink_to(EVENTS)
    batch = spark.read.parquet(EVENTS)
    out = windowed_scores(prepared(spark.readStream.schema(batch.schema).parquet(str(source))), window="1 day")
    run = out.writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((str(r.window_start), r.producer, r.n, round(r.mae, 8)) for r in spark.table("scores").collect())
    same = sorted((str(r.window_start), r.producer, r.n, round(r.mae, 8)) for r in windowed_scores(prepared(batch), window="1 day").collect())
    sql = duckdb.sql(f"select cast(date_trunc('day', ts) as timestamp)::varchar, event_type, count(*), round(avg(abs(value - 10)), 8) from '{EVENTS}' group by 1, 2").fetchall()
    assert got == same and len(got) == len(sql) and sum(x[2] for x in got) == sum(x[2] for x in sql)

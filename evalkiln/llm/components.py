"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from evalkiln.llm.common import release, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return (node, component): the smallest node of the component, for every node that has an edge.

    ``edges`` holds two columns of one comparable type; direction, repeats and loops don't matter, and rows
    with a null end are no edges. An empty table gives an empty result. Each round is two aggregations and two
    joins over the edges; it is written to the shared folder, so lineage doesn't grow. No group is collected:
    the neighbours of a node are only reduced to their minimum, and the join back can be split where a node has
    very many of them. The minima are joined by sorting, not by broadcast, so no round sends them through the driver,
    and what tells whether a round changed anything is observed as the round is written, not by a job of its own.
    """
    now = written(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct(),
        "cc",
    )
    before = None
    while True:
        # Large star: every neighbour larger than a node goes to the smallest node of its neighbourhood.
        both = now.union(now.select("v", "u")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest)
        seen = Observation()
        written_now = small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("hash"))
        last, now = now, written(written_now, "cc")
        release(last)
        state = seen.get
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Centroid clustering of integer vectors by Lloyd's rounds, with exact results from a dual-tree search.

A cover tree is built once over each block of vectors; another one is built over the centroids in every round. A pair of
nodes (vectors, centroids) is pruned if distance bounds show that none of its centroids is nearest to any of its vectors;
a node of vectors for which one centroid is left takes it as a whole, by a difference of running sums. Pairs of leaves
are compared exactly, in integers. Bounds are doubles with a margin above their rounding errors, so pruning loses nothing,
ties included.

Vectors stay in the blocks where they were read: a round shuffles one partial sum for each task, centroid and component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalkiln.llm.common import filled, small_batches, table, written

#: Radii shrink by this factor from a node to its children.
BASE = 1.5
#: A node of so many vectors isn't divided.
LEAF = 32
#: Sums go through Spark in parts of so many bits, so that a decimal holds the sum of any number of them.
LIMB = 80
LONG_MAX = (1 << 63) - 1


class Tree(NamedTuple):
    """Nodes in an order in which children follow each other; node 0 is the root and has every row."""

    order: np.ndarray  # rows by leaves
    start: np.ndarray  # rows of a node, in that order; the first of them is its centre
    stop: np.ndarray
    radius: np.ndarray  # no row of the node is farther from its centre
    kids: np.ndarray  # the first child, and the one behind the last; equal for a leaf
    kids_end: np.ndarray


def margin(points: np.ndarray) -> float:
    """Above what rounding can change in a distance between points of this size."""
    return float(np.abs(points).max(initial=0.0)) * 1e-12 * math.sqrt(max(1, points.shape[1])) + 1e-9


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of the rows of a float matrix: nested centres, each farther than the children's radius from the others.

    Centres are chosen farthest first until every row of the node is covered. Repeated rows end in one leaf of radius 0.
    """
    unit = max(1.0, float(np.abs(points).max(initial=0.0)))
    scaled = points / unit  # squares stay finite
    square = np.einsum("ij,ij->i", scaled, scaled)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * scaled @ scaled.T, 0.0)) * unit
    order = np.arange(len(points))
    start, stop, radius, kids, kids_end = [0], [len(points)], [0.0], [0], [0]
    slack = margin(points)
    at = 0
    while at < len(start):
        lo, hi = start[at], stop[at]
        rows = order[lo:hi].copy()
        far = np.sqrt(np.square((points[rows] - points[rows[0]]) / unit).sum(axis=1)).max(initial=0.0) * unit
        radius[at] = far * (1 + 1e-9) + (slack if far else 0.0)
        kids[at] = kids_end[at] = len(start)
        if hi - lo > leaf and far > 0:
            near = apart[rows[0], rows].copy()
            owner = np.zeros(len(rows), np.int64)
            centres = [0]
            near[0] = -1.0
            while near.max() > far / BASE or len(centres) == 1:
                new = int(near.argmax())
                to = apart[rows[new], rows]
                closer = to < near
                owner[closer], near[closer] = len(centres), to[closer]
                owner[new], near[new] = len(centres), -1.0
                centres.append(new)
            for c, centre in enumerate(centres):
                own = rows[(owner == c) & (np.arange(len(rows)) != centre)]
                order[lo : lo + len(own) + 1] = np.concatenate(([rows[centre]], own))
                start.append(lo)
                lo += len(own) + 1
                stop.append(lo)
                radius.append(0.0)
                kids.append(0)
                kids_end.append(0)
            kids_end[at] = len(start)
        at += 1
    return Tree(order, np.array(start), np.array(stop), np.array(radius), np.array(kids), np.array(kids_end))


def exact(points: np.ndarray, reach: float) -> np.ndarray:
    """Whole numbers as 64-bit integers, or as Python's where squared distances up to ``reach`` could be too large."""
    if points.shape[1] * 4 * reach * reach < 2.0**62:
        return points.astype(np.int64)
    return np.array([[int(x) for x in row] for row in points], object).reshape(points.shape)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, index: Tree) -> tuple[np.ndarray, int]:
    """(the number of the nearest centroid of every row in tree order, leaf pairs compared); ties go to the smaller number.

    ``points`` are floats in tree order, whole numbers both.
    """
    reach = max(float(np.abs(points).max(initial=0.0)), float(np.abs(centroids).max(initial=0.0)))
    small = points.shape[1] * 4 * reach * reach < 2.0**53  # then doubles hold every product and sum exactly
    own, other = (points, centroids) if small else (exact(points, reach), exact(centroids, reach))
    squares, goal_squares = (np.einsum("ij,ij->i", x, x) for x in (points, centroids)) if small else (None, None)
    slack = margin(points) + margin(centroids)
    unit = max(1.0, reach)
    scaled, goals = points / unit, centroids[index.order] / unit
    out = np.zeros(len(points), np.int32)
    compared = 0

    def compare(rows: np.ndarray, numbers: np.ndarray) -> None:
        nonlocal compared
        compared += len(rows) * len(numbers)
        if small:
            apart = squares[rows, None] + goal_squares[numbers] - 2 * own[rows] @ other[numbers].T
        else:
            apart = ((own[rows, None, :] - other[None, numbers, :]) ** 2).sum(axis=2)
        out[rows] = numbers[apart.argmin(axis=1)]

    todo = [(0, np.array([0]))]
    while todo:
        node, over = todo.pop()
        divided = tree.kids_end[node] > tree.kids[node]
        while True:
            d = np.sqrt(np.square(goals[index.start[over]] - scaled[tree.start[node]]).sum(axis=1)) * unit
            most = d.min() + tree.radius[node]
            over = over[(d - tree.radius[node] - index.radius[over]) * (1 - 1e-9) - slack <= most * (1 + 1e-9) + slack]
            wide = (index.kids_end[over] > index.kids[over]) & ((index.radius[over] >= tree.radius[node]) | (not divided))
            if not wide.any():
                break
            over = np.concatenate([over[~wide], *[np.arange(index.kids[q], index.kids_end[q]) for q in over[wide]]])
        lo, hi = tree.start[node], tree.stop[node]
        numbers = np.sort(np.concatenate([index.order[index.start[q] : index.stop[q]] for q in over]))
        if len(numbers) == 1:
            out[lo:hi] = numbers[0]
        elif not divided:
            compare(np.arange(lo, hi), numbers)
        else:
            kids = np.arange(tree.kids[node], tree.kids_end[node])
            inner = tree.kids_end[kids] > tree.kids[kids]
            todo += [(k, over) for k in kids[inner]]
            leaves = kids[~inner]  # all at once: each against the centroids that are left
            size, r = tree.stop[leaves] - tree.start[leaves], tree.radius[leaves]
            rows = np.repeat(tree.start[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())
            at, goal = scaled[tree.start[leaves]], centroids[numbers] / unit
            d = np.sqrt(np.maximum(np.einsum("ij,ij->i", at, at)[:, None] + np.einsum("ij,ij->i", goal, goal) - 2 * at @ goal.T, 0.0)) * unit
            # The matrix product is good to about the square root of a double's precision near zero.
            rough = slack + 1e-6 * unit * math.sqrt(points.shape[1])
            far = (d - r[:, None]) * (1 - 1e-9) - rough > ((d.min(axis=1) + r) * (1 + 1e-9) + rough)[:, None]
            decided = far.sum(axis=1) == len(numbers) - 1
            whole = np.repeat(decided, size)
            out[rows[whole]] = np.repeat(numbers[d.argmin(axis=1)], size)[whole]
            if not whole.all():
                compare(rows[~whole], numbers)
    return out, compared


#: A block: ids and components (floats of whole numbers, as small as they fit) in tree order, and its tree.
BLOCK = "ids array<{kind}>, form string, dims int, points binary, start array<int>, stop array<int>, radius array<double>, kids array<int>, kids_end array<int>"


def _packed(points: np.ndarray) -> tuple[str, bytes]:
    most = np.abs(points).max(initial=0.0)
    form = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return form, points.astype(form).tobytes()


def blocks(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """Blocks of vectors in the shared folder, each with its cover tree; vectors stay in the partition that read them."""
    small_batches(vectors.sparkSession)
    whole = F.col(vector_col).cast("array<double>")
    kept = (F.size(whole) == dims) & F.forall(whole, lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), whole.alias("v")).where(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.floor(np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dims) * scale)
                tree = cover_tree(points)
                form, held = _packed(points[tree.order])
                values = [batch.column("id").take(pa.array(tree.order)), form, dims, held, tree.start, tree.stop, tree.radius, tree.kids, tree.kids_end]
                kinds = [pa.list_(batch.schema.field("id").type), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                names = ["ids", "form", "dims", "points", "start", "stop", "radius", "kids", "kids_end"]
                one = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), values[0])] + [pa.array([x], k) for x, k in zip(values[1:], kinds[1:])]
                yield pa.RecordBatch.from_arrays(one, names=names)

    return written(rows.mapInArrow(run, BLOCK.format(kind=rows.schema["id"].dataType.simpleString())), "vectors")


def _opened(row) -> tuple[np.ndarray, Tree]:
    points = np.frombuffer(row.points, row.form).astype(np.float64).reshape(-1, row.dims)
    return points, Tree(np.arange(len(points)), *(np.asarray(getattr(row, x)) for x in ("start", "stop", "radius", "kids", "kids_end")))


def _sums(held: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """centroid -> (count, componentwise sums) of the vectors nearest to it; one partial sum a task is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goals = np.array(centroids, np.float64)
        index = cover_tree(goals, 1)
        count, total = [0] * len(goals), np.zeros(goals.shape, object)
        for pdf in filled(batches):
            for row in pdf.itertuples():
                points, tree = _opened(row)
                who, _ = nearest(points, tree, goals, index)
                whole = exact(points, float(np.abs(points).max()))
                for c in np.unique(who):
                    count[c] += int((who == c).sum())
                    total[c] += whole[who == c].sum(axis=0).astype(object)
        found = []
        for c in range(len(goals)):
            for i, x in enumerate(total[c] if count[c] else ()):
                x, limb = int(x), 0
                while limb == 0 or x not in (0, -1):
                    found.append((c, i, limb, Decimal(x & (1 << LIMB) - 1), count[c]))
                    x, limb = x >> LIMB, limb + 1
                if x:
                    found.append((c, i, limb, Decimal(x), count[c]))
        if found:
            yield pd.DataFrame(found, columns=["cluster", "at", "limb", "part", "n"])

    parts = held.mapInPandas(run, "cluster int, at int, limb int, part decimal(38,0), n bigint")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part"), F.sum("n").alias("n")).collect():
        n, total = out.setdefault(r.cluster, (0, [0] * len(centroids[0])))
        total[r.at] += int(r.part) << (LIMB * r.limb)
        out[r.cluster] = (max(n, r.n), total)
    return out


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, k: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; vectors of one id in the order of their components, without an id last."""
    whole = F.col(vector_col).cast("array<double>")
    kept = (F.size(whole) == dims) & F.forall(whole, lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = vectors.where(kept).select(key.alias("key"), F.transform(whole, lambda x: x * scale).alias("v")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return [[math.floor(x) for x in r.v] for r in rows]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` finite components.

    Components become floor(scale * x). The first ``k`` vectors by a hash of seed and id are the first centroids. Each
    round assigns vectors to the nearest centroid (ties: the smaller number) and moves every centroid that has vectors to
    the floor of their mean; empty ones stay. Vectors of another length, with a null, NaN or infinite component (or one
    that the scale makes infinite) are left out. Repeated vectors and ids are rows of their own; with fewer vectors than
    ``k`` there are fewer centroids; other columns aren't read; an empty table gives an empty result. Distances and sums
    that don't fit a long are null. ``k`` times ``dims`` numbers are held by the driver and by each task.
    """
    spark: SparkSession = vectors.sparkSession
    held = blocks(vectors, id_col, vector_col, dims, scale)
    kind = vectors.schema[id_col].dataType.simpleString()
    centroids = first_centroids(vectors, id_col, vector_col, dims, scale, k, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _sums(held, centroids).items():
            centroids[c] = [x // n for x in total]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goals = np.array(centroids, np.float64)
        index = cover_tree(goals, 1)
        for pdf in filled(batches):
            for row in pdf.itertuples():
                points, tree = _opened(row)
                who, _ = nearest(points, tree, goals, index)
                reach = max(float(np.abs(points).max()), float(np.abs(goals).max()))
                apart = ((exact(points, reach) - exact(goals, reach)[who]) ** 2).sum(axis=1)
                yield pd.DataFrame({"id": row.ids, "cluster": who, "distance": pd.array([int(x) if x <= LONG_MAX else None for x in apart], "Int64")})

    if not centroids:
        empty = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    found = written(held.mapInPandas(run, f"id {kind}, cluster int, distance bigint"), "clusters")
    lost = F.max(F.col("distance").isNull())
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), lost.alias("lost")).collect()
    fits = lambda x, bad: None if bad or x is None or x > LONG_MAX else int(x)
    every = fits(sum(r.total or 0 for r in sums), any(r.lost for r in sums))
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = spark.createDataFrame([(r.cluster, fits(r.total, r.lost), every, digest[r.cluster]) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op11_sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds written out one by one: all vectors against all centroids."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, b.cluster, b.d FROM (SELECT vec_id, v, min({{'d': {apart}, 'cluster': cluster}}) AS b FROM v, c{i} GROUP BY vec_id, v))")
        if i < rounds:
            parts.append(f"s{i} AS MATERIALIZED (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY cluster, pos)")
            parts.append(f"m{i} AS MATERIALIZED (SELECT cluster, list((s - (((s % n) + n) % n)) // n ORDER BY pos) AS c FROM s{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from evalkiln.llm import dual_tree

NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=8, rounds=10, dims=64):
    """Lloyd's rounds in Python's integers; rows are (id, components)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    who = lambda v: min(range(len(cents)), key=lambda c: (apart(v, cents[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(who(v), []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, who(v), apart(v, cents[who(v)])) for i, v in kept]
    one = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return sorted([(i, c, long(d), long(sum(x for _, e, x in found if e == c)), long(sum(x for *_, x in found)), one(c)) for i, c, d in found], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select(NAMES).collect()], key=str)


def test_equals_sql_and_brute_force(spark, sf_dir):
    ours = rows_of(dual_tree.op11_centroid_clustering(spark, sf_dir))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        assert ours == sorted(db.execute(f"SELECT {', '.join(NAMES)} FROM ({dual_tree.op11_sql()})").fetchall(), key=str)
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert ours == brute([(r.vec_id, r.embedding) for r in given])


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact(seed):
    """Clustered, repeated, tied and very large vectors."""
    rng = np.random.default_rng(seed)
    points = np.floor(rng.normal(size=(6, 5))[rng.integers(0, 6, 300)] * 1000 + rng.normal(size=(300, 5)) * rng.choice([1, 50, 900], (300, 1)))
    points = np.concatenate([points, points[:60], np.repeat(points[:1], 80, 0)]) * (10.0 ** (12 * (seed % 2)))
    points = np.floor(points) if seed < 2 else np.floor(points / 400)
    cents = np.concatenate([points[:7], points[:2], points[5:6] + 1])
    tree = dual_tree.cover_tree(points)
    assert sorted(tree.order) == list(range(len(points)))
    for a, b, r in zip(tree.start, tree.stop, tree.radius):
        assert np.sqrt(((points[tree.order[a:b]] - points[tree.order[a]]) ** 2).sum(1)).max() <= r or r == 0
    who, compared = dual_tree.nearest(points[tree.order], tree, cents, dual_tree.cover_tree(cents, 1))
    whole, goals = points.astype(int).tolist(), cents.astype(int).tolist()
    for row, c in zip(tree.order, who):
        each = [sum((int(x) - int(y)) ** 2 for x, y in zip(whole[row], g)) for g in goals]
        assert each[c] == min(each) and c == each.index(min(each))
    assert compared < points.shape[0] * len(cents)


def test_odd_rows(spark):
    """Nulls, wrong lengths, infinities, copies, a null id, huge components, and columns whose names clash."""
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=64).astype("float32")]) for i in range(40)]
    bad = [(100, None), (101, [1.0] * 63), (102, [None] + [1.0] * 63), (103, [float("nan")] * 64), (104, [float("inf")] + [0.0] * 63), (105, [])]
    more = [good[3], good[3], (3, good[4][1]), (None, good[5][1]), (7, [0.0] * 64)]
    given = [(i, v, "x", 5) for i, v in good + bad + more]
    df = spark.createDataFrame(given, "vec_id bigint, embedding array<float>, cluster string, n int").repartition(3)
    assert rows_of(dual_tree.cluster(df)) == brute([(i, v) for i, v, *_ in given])
    huge = [(i, [(-1.0) ** i * 3e30 * (i + 1)] + v[1:]) for i, v in good[:20]]
    huge = [(i, [float(np.float32(x)) for x in v]) for i, v in huge]
    assert rows_of(dual_tree.cluster(spark.createDataFrame(huge, "vec_id bigint, embedding array<float>"))) == brute(huge)
    few = good[:3] + [good[0]]
    assert rows_of(dual_tree.cluster(spark.createDataFrame(few, "vec_id bigint, embedding array<float>"))) == brute(few)
    none = spark.createDataFrame(bad, "vec_id bigint, embedding array<float>")
    assert dual_tree.cluster(none).count() == 0 and dual_tree.cluster(none.limit(0)).columns == NAMES

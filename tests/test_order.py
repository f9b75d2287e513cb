import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evalkiln.operators import chains, conformal, folds, order


@pytest.fixture(params=[7, 1_000_000])
def ranges(request, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", request.param)


def table(spark, n, seed=0):
    """Two thirds of the rows have one key, half of those one value; nulls in both."""
    r = random.Random(seed)
    rows = [(i, "hot" if r.random() < 0.66 else r.choice(["a", "b", None]), 5.0 if r.random() < 0.5 else r.choice([None, *[float(x) for x in range(20)]])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, k string, v double").repartition(3)


first = lambda x: (x is not None, x)  # noqa: E731  nulls first


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running(spark, ranges, n):
    rows, df = table(spark, n)
    got = {r.i: r for r in order.running(df, ["v", "i"], {"place": F.lit(1), "odd": F.col("i") % 2}, ["k"]).collect()}
    assert len(got) == n
    for i, k, v in rows:
        before = [x for x in rows if x[1] == k and (first(x[2]), x[0]) < (first(v), i)]
        assert (got[i].place, got[i].odd) == (len(before), sum(x[0] % 2 for x in before))
    whole = {r.i: r.position for r in order.position(df, "k", "v", "i").collect()}
    want = {x[0]: p for p, x in enumerate(sorted(rows, key=lambda x: (first(x[1]), first(x[2]), x[0])))}
    assert whole == want


def test_values_and_order_statistics(spark, ranges):
    rows, df = table(spark, 500)
    by = defaultdict(list)
    for _, k, v in rows:
        by[k].append(v)
    got = {(r.k, r.v): (r.before, r.ties) for r in order.rank_of_values(df, "v", ["k"]).collect()}
    assert got == {(k, v): (sum(first(x) < first(v) for x in vs), vs.count(v)) for k, vs in by.items() for v in set(vs)}
    wanted = [(k, r) for k, vs in by.items() for r in (1, 2, len(vs) // 2, len(vs), len(vs) + 1)]
    asked = spark.createDataFrame(wanted, "k string, rank bigint")
    found = sorted([tuple(r) for r in order.order_statistics(df, "v", asked, ["k"]).collect()], key=str)
    assert found == sorted([(k, r, sorted(by[k], key=first)[r - 1] if r <= len(by[k]) else None) for k, r in wanted], key=str)


def test_percentile_rank(spark, ranges):
    rows, df = table(spark, 300)
    by = defaultdict(list)
    for _, k, v in rows:
        by[k].append(v)
    got = {r.i: r.percentile for r in chains.percentile_rank(df, "k", "v").collect()}
    assert got == {i: 0.5 if len(by[k]) == 1 else (sum(first(x) < first(v) for x in by[k]) + (by[k].count(v) - 1) / 2) / (len(by[k]) - 1) for i, k, v in rows}


def test_no_task_gets_a_whole_key(spark, monkeypatch):
    """A key of all rows: every window is cut by range, or runs over counts of ranges."""
    monkeypatch.setattr(order, "RANGE_ROWS", 1000)
    df = spark.range(20_000).select(F.lit("y").alias("target"), (F.col("id") * 7919 % 10_007).cast("double").alias("residual"))
    ranged = order.with_range(df, ["target", "residual"])
    sizes = [r[1] for r in ranged.groupBy("__range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 6000
    radii = conformal.quantiles(df, conformal.coverages(spark, (0.5, 0.9)))
    plan = radii._jdf.queryExecution().executedPlan().toString()
    windows = [w for w in plan.splitlines() if "Window [" in w or "Window(" in w]
    assert windows and all("__range" in w for w in windows)
    values = sorted(r.residual for r in df.collect())
    assert {r.coverage: r.radius for r in radii.collect()} == {0.5: values[10_001 - 1], 0.9: values[18_001 - 1]}


def greedy(sizes, k):
    """(size, group index) -> fold, one group after the other."""
    loads, out = [0] * k, []
    for size, count in sizes:
        for i in range(count):
            f = loads.index(min(loads))
            loads[f] += size
            out.append((size, i, f))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 25)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(2, 7))
def test_runs_equal_the_greedy_rule(sizes, k):
    sizes = sorted(sizes, reverse=True)
    runs = defaultdict(list)
    for size, start, cycle in folds.placed_runs(sizes, k):
        runs[size].append((start, cycle))
    for size, i, fold in greedy(sizes, k):
        start, cycle = [r for r in runs[size] if r[0] <= i][-1]
        assert cycle[(i - start) % len(cycle)] == fold


def test_grouped_folds(spark, ranges):
    r = random.Random(1)
    rows = [(f"s{i:04d}", r.choice(["g1", "g2", "g3"]) if r.random() < 0.5 else f"h{r.randrange(80)}") for i in range(600)] + [("lone", None)]
    df = spark.createDataFrame(rows, "sample_id string, group_id string")
    size = Counter(g for _, g in rows if g)
    order_ = sorted(size, key=lambda g: (-size[g], g))
    want = {g: f for g, (_, _, f) in zip(order_, greedy([(size[g], 1) for g in order_], 4))}
    got = {x.sample_id: x.fold for x in folds.group_kfold(df, 4).collect()}
    assert got == {s: want[g] for s, g in rows if g}
    outer = folds.kfold(df, 3)
    fold = {x.sample_id: x.fold for x in outer.collect()}
    inner = {(x.outer_fold, x.sample_id): x.inner_fold for x in folds.nested_group_kfold(df, outer, 3, 2).collect()}
    expected = {}
    for f in range(3):
        size = Counter(g for s, g in rows if g and fold[s] != f)
        order_ = sorted(size, key=lambda g: (-size[g], g))
        at = {g: x for g, (_, _, x) in zip(order_, greedy([(size[g], 1) for g in order_], 2))}
        expected |= {(f"fold{f}", s): at[g] for s, g in rows if g and fold[s] != f}
    assert inner == expected
    nested = {(x.outer_fold, x.sample_id): x.inner_fold for x in folds.nested_kfold(outer, 3, 4).collect()}
    assert nested == {(f"fold{f}", s): i % 4 for f in range(3) for i, s in enumerate(sorted(s for s, _ in rows if fold[s] != f))}


def test_a_million_groups(spark):
    df = spark.range(1_500_000).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 1_000_000).alias("group_id"))
    began = time.perf_counter()
    loads = [r[1] for r in folds.group_kfold(df, 5).groupBy("fold").count().collect()]
    assert len(loads) == 5 and max(loads) - min(loads) <= 1
    assert time.perf_counter() - began < 60


def test_seeded_splits_over_several_ranges(spark, ranges):
    n = 60
    ids = spark.createDataFrame([(f"S{i:03d}",) for i in range(n)], "sample_id string").repartition(3)
    one = {r.sample_id: r.fold for r in folds.kfold(ids, 4, seed=3).collect()}
    assert len(one) == n and Counter(one.values()) == dict.fromkeys(range(4), n // 4)
    twice = {(r.repeat, r.sample_id): r.fold for r in folds.repeated_kfold(ids, 4, (3, 5)).collect()}
    assert len(twice) == 2 * n and all(twice[0, s] == f for s, f in one.items())
    split = [tuple(r) for r in folds.shuffle_split(ids, 2, 0.25, 5).collect()]
    for f in range(2):
        by_hash = sorted((hashlib.sha256(f"5:{f}:S{i:03d}".encode()).hexdigest(), f"S{i:03d}") for i in range(n))
        want = {(f"fold{f}", s, "validation" if at < n // 4 else "train") for at, (_, s) in enumerate(by_hash)}
        assert {x for x in split if x[0] == f"fold{f}"} == want


def test_ranges_keep_the_columns_of_the_caller(spark, ranges):
    df = spark.createDataFrame([(i, -i, str(i), i) for i in range(30)], "i int, __key int, __cuts string, __range_no int")
    got = order.position(df, "__key").collect()
    assert sorted((r["i"], r["__key"], r["__cuts"], r["position"]) for r in got) == [(i, -i, str(i), 29 - i) for i in range(30)]


def test_shuffle_split_moves_no_rows(spark):
    """Only the cut of each split is looked for: the rows that come out were neither sorted nor dealt out."""
    ids = spark.range(120_000).select(F.format_string("S%09d", "id").alias("sample_id"))
    split = folds.shuffle_split(ids, 2, 0.3, 5)
    got = {(r.fold_id, r.role): r["count"] for r in split.groupBy("fold_id", "role").count().collect()}
    assert got == {(f"fold{f}", role): n for f in range(2) for role, n in (("validation", 36_000), ("train", 84_000))}
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange hash", "Exchange range", "Sort", "Window") if x in plan]


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_shuffle_split_with_repeated_and_missing_ids(spark, monkeypatch, digits):
    """Equal samples on both sides of a cut; samples without an id come last, as in SQL."""
    monkeypatch.setattr(folds, "CUT_DIGITS", digits)
    for ids in (["a"] * 10, ["a"] * 7 + ["b"] * 9 + ["c", None, "d"], [None] * 6 + ["x", "y"], [None] * 5, [f"S{i}" for i in range(41)]):
        table = spark.createDataFrame([(i,) for i in ids], "sample_id string").repartition(3)
        for share in (0.3, 0.5, 0.75):
            want = Counter()
            for f in range(3):
                ordered = sorted(ids, key=lambda i: (i is None, hashlib.sha256(f"5:{f}:{i}".encode()).hexdigest()))
                want.update((f"fold{f}", s, "validation" if at < int(share * len(ids)) else "train") for at, s in enumerate(ordered))
            assert Counter(map(tuple, folds.shuffle_split(table, 3, share, 5).collect())) == want, (ids, share)

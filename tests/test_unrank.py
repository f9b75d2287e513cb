from itertools import combinations, permutations, product

import pytest
from pyspark.sql import functions as F

from evalkiln.checks import GraphValidation
from evalkiln.operators import space, unrank
from evalkiln.plans import graph


@pytest.mark.parametrize("n, k", [(1, 1), (5, 1), (5, 3), (5, 5), (9, 4)])
def test_subsets_and_arrangements(spark, n, k):
    subsets, orders = list(combinations(range(n), k)), list(permutations(range(n), k))
    got = unrank.ranks(spark, len(subsets)).select("i", unrank.subset_positions(F.col("i"), n, k).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in got] == subsets
    got = unrank.ranks(spark, len(orders)).select("i", unrank.arrangement_positions(F.col("i"), n, k).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in got] == orders


@pytest.mark.parametrize("first, second", [("pick", "pick"), ("pick", "arrange"), ("arrange", "pick"), ("arrange", "arrange")])
def test_then(spark, first, second):
    of = {"pick": combinations, "arrange": permutations}
    want = list(of[second](list(of[first](range(4), 2)), 2))
    got = unrank.ranks(spark, len(want)).select("i", unrank.then(F.col("i"), 4, (first, 2), (second, 2)).alias("p")).orderBy("i").collect()
    assert [tuple(map(tuple, r.p)) for r in got] == want


def test_large_spaces_cost_only_what_is_asked(spark):
    last = unrank.MAX_RANK
    r = spark.createDataFrame([(0,), (1,)], "i bigint").select(unrank.subset_positions(F.col("i"), 60, 30).alias("p")).collect()
    assert [x.p for x in r] == [list(range(30)), [*range(29), 30]]
    dims = [(f"d{j}", spark.range(100).select(F.col("id").alias("item"), F.col("id").alias("pos"))) for j in range(9)]
    at = spark.createDataFrame([(123456789012345678,)], "i bigint")
    assert tuple(unrank.products(at, dims).first())[1:] == (12, 34, 56, 78, 90, 12, 34, 56, 78)
    assert unrank.ranks(spark, last, 3).count() == 3
    for bad in (0, last + 1):
        with pytest.raises(ValueError):
            unrank.ranks(spark, bad)
    with pytest.raises(ValueError):
        unrank.arrangement_positions(F.col("i"), 60, 30)


def test_products_and_samples(spark):
    dims = [("a", ["x", "y"]), ("b", ["p", "q", "r"]), ("c", ["0", "1"])]
    tables = [(n, unrank.items_of(spark.createDataFrame([(v,) for v in (*vs, vs[0], None)], "v string"), "v")) for n, vs in dims]
    got = unrank.products(unrank.ranks(spark, 12), tables).orderBy("i").select("a", "b", "c").collect()
    assert [tuple(r) for r in got] == list(product(*[vs for _, vs in dims]))
    for count in (1, 5, 30, 100, 1000):
        drawn = [r.i for r in unrank.sampled_ranks(spark, 120, count, 4).collect()]
        assert len(set(drawn)) == len(drawn) == min(count, 120) and all(0 <= i < 120 for i in drawn)
    many = [r.i for r in unrank.sampled_ranks(spark, 10**15, 50, 4).collect()]
    assert len(set(many)) == 50 and many == [r.i for r in unrank.sampled_ranks(spark, 10**15, 50, 4).collect()] != [r.i for r in unrank.sampled_ranks(spark, 10**15, 50, 5).collect()]


def test_ranges_of_many_rows(spark):
    rows = [(0.1, 1.0, 0.1), (3.0, 1.0, -1.0), (1.0, 1.0, 5.0), (0.5, 3.0, 0.25)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a double, b double, s double")
    got = space.ranges(df, "a", "b", F.col("s")).collect()
    for k, r in enumerate(rows):
        assert sorted((x.i, x.value) for x in got if x.k == k) == sorted((x.i, x.value) for x in space.range_values(spark, *r).collect())
    for bad in ((1.0, 2.0, 0.0), (1.0, 2.0, -1.0), (0.0, 1.0, 1e-6), (0.0, float("inf"), 1.0)):
        with pytest.raises(Exception, match="campaign_validation"):
            space.ranges(spark.createDataFrame([bad], "a double, b double, s double"), "a", "b", F.col("s")).collect()
    logs = space.log_ranges(spark.createDataFrame([(1e-4, 1e2)], "a double, b double"), "a", "b", 7).orderBy("i").collect()
    assert [x.value for x in logs] == pytest.approx([10.0**e for e in range(-4, 3)])


def test_overrides(spark):
    o = lambda *rows: spark.createDataFrame(rows, "node string, param string, value string")
    assert space.merged_overrides(o(("a", "p", "1")), o(("a", "p", "1"), ("b", "p", None))).count() == 2
    for bad in (o(("a", "p", "2")), o(("a", "p", None))):
        with pytest.raises(Exception, match="conflicting overrides of a.p"):
            space.merged_overrides(o(("a", "p", "1")), bad).collect()


def test_levels_of_a_graph_table(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d"), ("a", "b")]
    df = spark.createDataFrame(edges, "src string, dst string")
    want = {n: i for i, level in enumerate(graph.Graph.of(edges=list(dict.fromkeys(edges))).levels()) for n in level}
    assert {r.node: r.level for r in graph.levels(df).collect()} == want
    with pytest.raises(GraphValidation, match="cycle"):
        graph.levels(df.union(spark.createDataFrame([("d", "b")], "src string, dst string")))
    with pytest.raises(GraphValidation):
        graph.levels(spark.createDataFrame([("a", "a")], "src string, dst string"))

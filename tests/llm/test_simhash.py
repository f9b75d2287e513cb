import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalkiln.llm import simhash
from evalkiln.llm.components import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """id -> smallest id reachable, for (id, fingerprint) pairs."""
    found = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 2 and found[j] < found[i]:
                    found[i], changed = found[j], True
    return found


def test_fingerprints_equal_brute_force():
    for text in [None, "", " \t", "one", "One TWO", "a b c d e f", "É é \xa0 x\x0by", "word " * 5000, "x\ny\r\nz q"]:
        assert simhash.fingerprint(text) == brute_print(text), text


def test_hash_is_the_one_of_spark(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("code", [simhash.CODE, simhash.CODE_FINE])
def test_covering_loses_no_pair(code):
    rng = np.random.default_rng(3)
    one = rng.integers(-(2**63), 2**63 - 1, 400)
    two = np.array([x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, int(rng.integers(0, 3)), replace=False).astype(np.uint64), initial=np.uint64(0)).astype(np.int64) for x in one], np.int64)
    anchors, places = simhash.replicas(two, 2, code)
    of = [set(anchors[places == i].tolist()) for i in range(len(two))]
    assert all(home in of[i] for i, home in enumerate(simhash.homes(one, code).tolist()))
    assert sum(map(len, of)) == len(anchors)


def test_replicas_are_all_words_within_the_block_distances():
    """Brute force over the 4,096 words of one block."""
    code = simhash.CODE[:1]
    words = np.unique(simhash.homes(np.arange(1 << 23), code))
    assert len(words) == 4096
    fps = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 50)
    anchors, places = simhash.replicas(fps, 2, code)
    for i, fp in enumerate(fps.tolist()):
        want = [w for w in words.tolist() if ((fp & (1 << 23) - 1) ^ w).bit_count() <= 5]
        assert sorted(anchors[places == i].tolist()) == want


def test_code_follows_the_work():
    assert simhash.code_for(0) == simhash.code_for(10**6) == simhash.CODE
    assert simhash.code_for(2 * 10**8) == simhash.code_for(10**11) == simhash.CODE_FINE
    assert 55 < simhash.replicas_each(2, simhash.CODE) < 65 and 140 < simhash.replicas_each(2, simhash.CODE_FINE) < 165


@pytest.mark.parametrize("code", [None, simhash.CODE_FINE])
def test_pairs_equal_brute_force(spark, code):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 60)
    prints = sorted({int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 4)), replace=False))) for b in base for _ in range(6)})
    got = {(r.src, r.dst) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp bigint"), code=code).collect()}
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 90)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 90, 90: 90} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_groups_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of them in the deep dark wood".split()
    rows = [(i, " ".join(base * 30 + [f"w{i % 5}"])) for i in range(20)] + [(30, None), (31, ""), (32, "one"), (33, "one"), (34, "ONE")] + [(40 + i, f"text number {i} is unlike {i * i}") for i in range(10)]
    want = brute_groups([(i, brute_print(t)) for i, t in rows])
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fingerprint == f"{brute_print(dict(rows)[r.doc_id]):016x}" for r in got)


def test_edges(spark, edge_docs, no_docs):
    assert simhash.simhash_groups(edge_docs).count() == edge_docs.count()
    assert simhash.simhash_groups(no_docs).count() == 0


def test_replicas_are_not_broadcast(spark):
    """Spark takes the replicas to be as small as the fingerprints; there are 60 for each."""
    pairs = simhash.near_pairs(spark.range(1000).select(F.xxhash64("id").alias("fp")), code=simhash.CODE)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_groups_of_very_many_rows_are_broadcast(spark, monkeypatch):
    """Prints, labels and groups grow with the documents; only groups of a thousandth of all rows have a bound."""
    plans = []
    write = simhash.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "written", lambda df, *a, **b: (plan(df), write(df, *a, **b))[1])
    docs = spark.createDataFrame([(i, f"text {i // 2} of {i // 2 * 7}") for i in range(20)], "doc_id bigint, text string")
    got = simhash.simhash_groups(docs)
    assert not [p for p in plans if "Broadcast" in p] and "SortMergeJoin" in plans[-1]
    plan(got)
    assert plans[-1].count("SortMergeJoin") == 1 and plans[-1].count("BroadcastHashJoin") == 2
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i in range(20)}

import random
from fractions import Fraction

import corpus_pipeline as C
import numpy as np
from evalkiln.llm import similar
from pyspark.sql import functions as F


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """id -> smallest id reachable over pairs with a coefficient of at least 0.8, for id -> text."""
    sets = {i: shingles(t) for i, t in texts.items()}
    found = {i: i for i in sets}

    def top(i):
        return i if found[i] == i else top(found[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                found[b] = a
    return {i: top(i) for i in sets}


def test_near_copies_at_the_threshold(spark):
    """Of 104 words one changed in the middle leaves 95 of 105 shingles; three leave 85 of 115; two just reach 0.8."""
    base = [f"w{i}" for i in range(104)]
    edit = lambda *places: " ".join(f"new{i}" if i in places else w for i, w in enumerate(base))
    rows = [(1, edit()), (2, edit(50)), (3, edit(20, 50, 80)), (4, edit(10, 90)), (5, " ".join(base[52:])), (6, " ".join(base).upper()), (7, None), (8, ""), (9, "one two"), (10, "one  TWO"), (11, "one three")]
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(dict(rows)) and got[2] == 1 and got[5] == 5


def test_copies_at_every_distance_from_one_text(spark):
    """Copies with 0 to 6 changed words of 120, each in its own places: those near the text are one group over it, those
    far from it are linked only to what is really near them."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"own{i}x{j}" if j in changed else w for j, w in enumerate(base))) for i in range(1, 240) for changed in [set(rng.sample(range(120), rng.randrange(7)))]]
    rows += [(300 + i, text + f" one more word at the end of {i}") for i, text in rows[::9]]
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(dict(rows)) and 20 < len(set(got.values())) < 200


def test_groups_equal_brute_force_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == brute_groups(texts)


def test_stage_drops_near_copies_and_keeps_the_rest(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = brute_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in C.simhash_near_dedup(spark, docs, sf_dir).collect()} == {i for i, g in groups.items() if i == g}


def test_one_row_of_each_group_stays(spark, sf_dir):
    """A copy under an id that another group keeps goes all the same, and equal ids in one group leave one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (8, c + " end"), (9, c.upper()), (None, a), (None, "only here"), (None, "only here"), (11, None), (12, "")]
    kept = C.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), sf_dir).collect()
    assert sorted(((r.doc_id or 0, (r.text or "").lower()) for r in kept)) == sorted([(3, b), (5, a), (7, c), (0, "only here"), (11, "")])


def test_simhash_candidates_are_those_of_operator_8():
    near = " ".join(f"w{i}" for i in range(2000))
    one, two = (similar.shingle_print(similar.shingle_set(t)) for t in (near, near.replace("w777 ", "other ")))
    far = similar.shingle_print(similar.shingle_set(" ".join(f"x{i}" for i in range(2000))))
    assert (one ^ two).bit_count() <= 4 < ((one ^ far) & (2**64 - 1)).bit_count() and similar.shingle_print(similar.shingle_set("")) == 0


def test_exact_fraction_decides():
    a = similar.shingle_set(" ".join(f"w{i}" for i in range(13)))
    assert len(a) == 9 and similar.jaccard_reaches(a[:8], a[:], Fraction(8, 9)) and not similar.jaccard_reaches(a[:7], a, Fraction(4, 5))


def test_edges(spark, edge_docs, no_docs):
    assert similar.similar_groups(edge_docs).count() == edge_docs.count()
    assert similar.similar_groups(no_docs).count() == 0 == similar.first_of_groups(no_docs).count()
    clash = edge_docs.withColumnsRenamed({"kept": "sid", "score": "row"})
    assert similar.first_of_groups(clash).columns == clash.columns


def test_released_tables_leave_the_catalog(spark):
    from evalkiln.llm.common import bucketed, release, written

    df = spark.range(10)
    tables = [bucketed(df, "catalog-test", "id", 2), written(df, "catalog-test")]
    before = [t.name for t in spark.catalog.listTables() if t.name.startswith("evalkiln_")]
    assert before and all(t.count() == 10 for t in tables)
    release(*tables)
    assert len([t.name for t in spark.catalog.listTables() if t.name.startswith("evalkiln_")]) == len(before) - 1


def test_parities_bound_the_difference_of_two_sets(spark):
    """The differing bits never exceed the shingles of one set only, also over two lengths, and tell unrelated sets apart."""
    rng = random.Random(6)
    new = lambda n: {rng.getrandbits(64) for _ in range(n)}
    rows = []
    for n, m, both in [(0, 0, 0), (0, 3, 0), (1, 1, 1), (250, 262, 240), (500, 530, 490), (1000, 1030, 0), (3000, 3000, 2900), (200, 1200, 150), (400, 400, 0)]:
        common = new(both)
        a, b = common | new(n - both), common | new(m - both)
        rows.append((len(a ^ b), *(similar.parity(np.array(sorted(x), np.uint64)).tolist() for x in (a, b))))
    table = spark.createDataFrame(rows, "apart int, a array<bigint>, b array<bigint>")
    got = [(r.apart, r.n) for r in table.select("apart", similar.differing_bits(F.col("a"), F.col("b")).alias("n")).collect()]
    assert all(n <= apart and (apart - n) % 2 == 0 for apart, n in got) and {len(a) for _, a, _ in rows} == {4, 8, 16, 64}
    assert got[5][1] * 9 > 2030 and got[8][1] * 9 > 800 and got[7][1] == 0


def test_texts_of_unlikely_candidates_stay_where_they_are(spark, monkeypatch):
    """Of 120 texts that share one passage of 40 words in 240, none is a candidate whose text is read."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"own{i}x{rng.getrandbits(40)}" for _ in range(200)])) for i in range(120)] + [(500, " ".join(f"w{i}" for i in range(90))), (501, " ".join(f"w{i}" for i in range(91)))]
    seen = []
    write = similar.written

    def watched(df, name, *a, **b):
        out = write(df, name, *a, **b)
        if name in ("similar-first", "similar-second"):
            seen.extend(out.collect())
        return out

    monkeypatch.setattr(similar, "written", watched)
    monkeypatch.setattr(similar, "BUCKETS", 2)  # tells rare shingles from frequent ones as little as a very large corpus does
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: min(i, 500) for i, _ in rows} and len(seen) == 1


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """However small Spark takes a side to be, all joins are by sorting: none of these tables has a bound."""
    plans = []
    write = similar.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(similar, "written", lambda df, *a, **b: (plan(df), write(df, *a, **b))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}x{j}" for j in range(40 + i % 3))) for i in range(30)], "doc_id bigint, text string")
    kept = similar.first_of_groups(docs)
    plan(kept)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 3))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 15 and not [p for p in plans if "Broadcast" in p]

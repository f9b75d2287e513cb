import hashlib
import random
import re

from evalkiln.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))


def brute(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(size, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[at : at + n]:
                    hit.update(range(i, i + n))
                    found.add("null" if item_id is None else str(item_id))
    return len(own), len(hit), sorted(found)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "É", "x1", "b", "c", "d'e"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for i in range(12)] + [(50, None), (None, text(12)), (51, "")]
    docs = [(i, text(rng.randint(0, 60)) + (" " + (items[i % 12][1] or "") + "," + text(5) if i % 3 == 0 else "")) for i in range(60)] + [(100, None), (101, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (D.BLOCK_WORDS, 20):
        got = D.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), bench, block_words=block_words).withColumn("n_hit", D.n_hit()).collect()
        for r in got:
            assert (r.n_words, r.n_hit, list(r["items"])) == brute(dict(docs)[r.doc_id], items)


def test_longest_matches_are_maximal(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "start w3 " + " ".join(f"w{i}" for i in range(5, 31)) + " end"
    r = D.scan(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert [m.asDict() for m in r.matches] == [{"item_id": "7", "item_pos": 5, "doc_pos": 2, "n_words": 26, "n_places": 1}]
    assert (list(r.hit_from), list(r.hit_to)) == ([2], [28])


def longest(text, items, size=10):
    """Every maximal run of common words of at least the window, by comparing all pairs of places."""
    own, out = words(text), []
    for item_id, item in items:
        w = words(item)
        for i in range(len(own)):
            for j in range(len(w)):
                if i and j and own[i - 1] == w[j - 1]:
                    continue
                n = 0
                while i + n < len(own) and j + n < len(w) and own[i + n] == w[j + n]:
                    n += 1
                if n >= min(size, len(w)) and n:
                    out.append((str(item_id), j, i, n))
    return sorted(out, key=lambda m: (m[2], -m[3], m[0], m[1]))


def test_every_place_is_found(spark):
    """A window that stands twice in one item and once in another has three places; runs of one word have many."""
    block = " ".join(f"w{i}" for i in range(12))
    rng = random.Random(3)
    items = [(1, f"{block} x {block} y"), (2, f"z {block}"), (3, "a " * 30), (4, " ".join(rng.choice("ab") for _ in range(60)))]
    docs = [(1, f"q {block} r"), (2, f"{block} x {block} {block}"), (3, "a " * 40), (4, " ".join(rng.choice("ab") for _ in range(200)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (D.BLOCK_WORDS, 20):
        got = D.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), bench, block_words=block_words).collect()
        for r in got:
            assert sorted((m.item_id, m.item_pos, m.doc_pos, m.n_words) for m in r.matches) == sorted(longest(dict(docs)[r.doc_id], items))
    assert len(longest(docs[0][1], items)) == 3


def test_drop_and_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "x y z x y z x y z x y z"), (2, None)], "item_id bigint, text string")
    kept = D.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1
    assert D.drop_contaminated(no_docs, bench).count() == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert D.drop_contaminated(edge_docs.withColumnRenamed("kept", "n_words"), empty).columns[2] == "n_words"
    assert D.drop_contaminated(edge_docs, empty).count() == edge_docs.count()


def windows_in(own, by_length):
    """The words of a text in any occurrence of a window, and the items of those windows, by a look-up of every place."""
    hit, found = set(), set()
    for n, windows in by_length.items():
        for i in range(len(own) - n + 1):
            if (ids := windows.get(tuple(own[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                found |= ids
    return len(hit), sorted(found)


def test_query(spark, sf_dir):
    """Every document of the table, whole, against brute force."""
    by_length = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(w[at : at + n]), set()).add(str(r.item_id))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = D.op9_benchmark_decontamination(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        own = words(texts[r.doc_id])
        hit, found = windows_in(own, by_length)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(own), hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)


def test_a_line_of_very_many_items_is_told_once(spark):
    """Hits and items are whole either way; without every place a document has a match for each place of its own, not of the items."""
    line = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(i, f"{line} tail{i} x{i}") for i in range(300)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"before {line} after"), (2, f"{line} tail7 x7"), (3, "nothing of it")], "doc_id bigint, text string")
    whole = {r.doc_id: r for r in D.scan(docs, bench).collect()}
    short = {r.doc_id: r for r in D.scan(docs, bench, every_place=False).collect()}
    for i in (1, 2, 3):
        assert (whole[i].hit_from, whole[i].hit_to, whole[i].items) == (short[i].hit_from, short[i].hit_to, short[i].items)
    assert len(whole[1].matches) == 300 and len(whole[1].items) == 300
    assert len(short[1].matches) <= 3 and short[1].matches[0].n_places == 300 and short[1].matches[0].doc_pos == 1
    assert short[3].matches == [] and D.drop_contaminated(docs, bench).count() == 1

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalkiln.llm import brown


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_of(rows):
    """(counts, N, V, {row: (n_tokens, n_known, base)}) straight from the definition."""
    count = Counter(w for i, t in rows if not held(i) for w in pieces(t))
    n, v = sum(count.values()), len(count)
    line = lambda t: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in pieces(t))
    return count, n, [(i, held(i), len(pieces(t)), sum(count[w] > 0 for w in pieces(t)), n, line(t)) for i, t in rows]


def direct(model, count, text):
    """The score word by word, with dictionaries."""
    v = model.vocab
    number = {w.decode(): i for i, w in enumerate(v.words[: v.own])}
    unit = lambda w: v.end if w is None else number.get(w, v.own + 1 + zlib.crc32(w.encode()[-3:]) % brown.ENDINGS)
    total, before = 0.0, model.classes[v.end]
    for w in pieces(text):
        u = unit(w)
        total += model.follows[before, model.classes[u]] + model.emits[u]
        if u > v.end:
            e = u - v.end - 1
            total += math.log10((count[w] + 0.5) / (v.ending_tokens[e] + 0.5 * (v.ending_types[e] + 1)))
        before = model.classes[u]
    return total


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("units, known", [(brown.UNITS, brown.KNOWN), (300, 2000)])
def test_against_brute_force(spark, small, monkeypatch, units, known):
    """With all words known, and with rare words that only the join knows."""
    monkeypatch.setattr(brown, "UNITS", units)
    monkeypatch.setattr(brown, "KNOWN", known)
    monkeypatch.setattr(brown, "HELD", 1000)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    count, n, want = base_of(rows)
    model = brown.train(small.where(~brown.held_out()))
    assert (model.vocab.tokens, model.vocab.types, model.vocab.texts) == (n, len(count), count[None])
    assert {w.decode() for w in model.vocab.words} == {w for w, c in count.items() if w is not None and c * known >= n}
    rare = Counter()
    for w, c in count.items():
        if w is not None and c * units < n:
            rare[brown.ending(w.encode())] += c
    assert all(model.vocab.ending_tokens[e] == rare[e] for e in range(brown.ENDINGS))
    got = {r.doc_id: r for r in brown.score(small, model).collect()}
    for i, h, tokens, seen, every, base in want:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, seen, every)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(direct(model, count, dict(rows)[i]), rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / tokens), rel=1e-9)


def test_probabilities_add_up(small):
    model = brown.train(small.where(~brown.held_out()))
    v = model.vocab
    for before in range(brown.CLASSES):
        if (model.classes == before).any():
            each = 10 ** (model.follows[before, model.classes] + model.emits)
            assert each.sum() == pytest.approx(1)
    counts = Counter({w: int(c) for w, c in zip(v.words, v.counts)})
    rare = model.counts.where(F.col("n") * brown.UNITS < v.tokens).select("n").toPandas().n
    assert (rare + 0.5).sum() + 0.5 * brown.ENDINGS == pytest.approx((v.ending_tokens + 0.5 * (v.ending_types + 1)).sum())
    assert len(counts) == len(v.words)


def test_bigrams_and_gains(spark):
    """Bigrams of units as counted one by one; a gain is the change of the likelihood."""
    texts = ["a b a a c", "b a", "", None, "c c c d a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    vocab = brown.vocabulary(brown.word_counts(df), len(texts))
    name = {w.decode(): i for i, w in enumerate(vocab.words)} | {None: vocab.end}
    want = Counter((name[x], name[y]) for t in texts for x, y in zip([None, *pieces(t)], pieces(t)))
    held = brown.neighbours(df, vocab)
    got = {(r.unit, p.other): p.n for r in held.collect() for p in r.pairs if p.right}
    assert got == want == {(p.other, r.unit): p.n for r in held.collect() for p in r.pairs if not p.right}
    rng = np.random.default_rng(0)
    m = rng.poisson(3.0, (9, 9)) * rng.integers(0, 2, (9, 9))
    classes = np.array([0, 1, 1, 2, 2, 3, 3, 3, 1])
    between = lambda c: np.array([[m[np.ix_(c == a, c == b)].sum() for b in range(5)] for a in range(5)])
    for unit in range(1, 9):
        left, right = (np.array([x[classes == c].sum() for c in range(5)]) for x in (m[:, unit], m[unit]))
        gain = brown.gains(left, right, int(m[unit, unit]), classes[unit], between(classes))
        for c in range(5):
            other = classes.copy()
            other[unit] = c
            change = brown.likelihood(between(other)) - brown.likelihood(between(classes))
            assert gain[c] - gain[classes[unit]] == pytest.approx(change, abs=1e-9)


def test_exchange_finds_classes(spark):
    """Two alternating groups of words: their classes tell them apart, and held-out texts score above the base."""
    rng = np.random.default_rng(2)
    line = lambda: " ".join(f"{'xy'[k % 2]}{rng.integers(0, 30)}" for k in range(60))
    df = spark.createDataFrame([(i, line()) for i in range(300)], "doc_id bigint, text string").repartition(4)
    model = brown.train(df.where(~brown.held_out()), k=6)
    found = {w.decode(): int(c) for w, c in zip(model.vocab.words, model.classes)}
    assert not {c for w, c in found.items() if w[0] == "x"} & {c for w, c in found.items() if w[0] == "y"}
    test = brown.score(df.where(brown.held_out()), model).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert test[0] - test[1] > 0.25 * test[2]


def test_held_out_gain(spark):
    """On the given documents the classes tell more than counts alone; the same table in other partitions scores the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = brown.train(docs.where(~brown.held_out()))
    got = brown.score(docs, model)
    test = got.where(brown.held_out()).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert test[0] - test[1] > 0.1 * test[2]
    again = brown.train(docs.repartition(7).where(~brown.held_out()))
    assert (again.classes == model.classes).all()


def test_edges(spark, edge_docs, no_docs):
    clash = edge_docs.withColumnRenamed("kept", "row").withColumnRenamed("score", "rare")
    model = brown.train(clash.where(~brown.held_out()))
    got = brown.score(clash, model)
    assert got.columns == ["doc_id", "text", "row", "rare", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    _, _, want = base_of(rows)
    key = lambda r: (r[0] is None, r[0], r[2])
    for r, w in zip(sorted([(r.doc_id, held(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got.collect()], key=key), sorted(want, key=key)):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], rel=1e-9)
    assert all(math.isfinite(r.score) for r in got.collect())
    nothing = brown.train(no_docs)
    assert brown.score(no_docs, nothing).count() == 0
    first = brown.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), nothing).first()
    assert (first.n_tokens, first.n_known, first.train_tokens, first.base_score) == (3, 0, 0, 0.0) and first.score < 0

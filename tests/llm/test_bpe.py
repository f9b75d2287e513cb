import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from evalkiln.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(PATH).rank, special_tokens={})


def some_words(n, most):
    rng = random.Random(2)
    return [w for w in ("".join(rng.choice("aeinrst theoué中😀0! ") for _ in range(rng.randint(1, most))).encode() for _ in range(n))]


def test_folds_equal_the_library(reference):
    ranks = bpe.ranks_of(PATH)
    for w in some_words(500, 60):
        want = reference._core_bpe.encode_single_piece(w)
        assert ranks.fold(w) == want
        assert w in ranks.rank or ranks._fold_long(w) == want


def test_higher_order_fold_equals_the_library(spark, reference):
    words = spark.createDataFrame([(w,) for w in some_words(150, 20)] + [(b"",)], "w binary")
    for r in words.select("w", bpe.fold_words(F.col("w"), bpe.ranks_of(PATH)).alias("ids")).collect():
        assert list(r.ids) == (reference._core_bpe.encode_single_piece(bytes(r.w)) if r.w else [])


def test_texts_equal_the_library_and_round_trip(spark, reference):
    rng = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "word", "'s", "don't", "é", "中文", "😀", "1234", "...", "\t", "x" * 100, " " * 200, "The", "\r\n", "　", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "a" * 30_000), (903, " " * 9000 + "b")]
    found = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, P.PATTERN), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        assert list(r.ids) == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_query(spark, sf_dir, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op5_byte_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark, edge_docs, no_docs):
    out = bpe.encode(edge_docs, PATH, P.PATTERN)
    assert out.count() == edge_docs.count() and out.columns == [*edge_docs.columns, "ids"]
    assert bpe.encode(no_docs, PATH, P.PATTERN).count() == 0


def test_folded_words_leave_no_vocabulary_on_the_driver(spark, reference):
    docs = spark.createDataFrame([(1, "the the the café's end end"), (2, None)], "doc_id bigint, text string")
    bpe.ranks_of.cache_clear()
    known = bpe.folded_words(docs, PATH, P.PATTERN)
    assert {" the", " café", "'s", " end"} <= set(known)
    assert all(list(memoryview(ids).cast("i")) == reference.encode_ordinary(w) for w, ids in known.items())
    assert bpe.ranks_of.cache_info().currsize == 0


def test_words_of_a_batch_are_folded_together(reference, monkeypatch):
    """No distinct word is folded by a call of its own, which took most of the time; bounds between texts and chunks hold."""
    monkeypatch.setattr(bpe.Ranks, "fold", None)
    rng = random.Random(4)
    letters = ["a", "eing", "th", " ", " ", "\n", "é", "中", "'s", "7", "!", "\x1c", "　", "x" * 70]
    texts = [None, "", " ", "a", " b", "c ", "d  e", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300))]
    encoder = bpe.Encoder(PATH, P.PATTERN, {" a": bytes(reference.encode_ordinary(" a")[0].to_bytes(4, "little"))})
    ids = encoder.of_texts(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [reference.encode_ordinary(t or "") for t in texts]
    assert bpe.joined_pieces(ids, pa.array(encoder.ranks.pieces, pa.large_binary())).to_pylist() == [(t or "").encode() for t in texts]
    words = [*some_words(300, 90), b"", b"a"]
    assert [list(memoryview(x).cast("i")) for x in encoder.ranks.fold_all(words)] == [reference._core_bpe.encode_single_piece(w) if w else [] for w in words]


def test_plans_of_the_fold_do_not_spell_out_the_rank_map(spark, monkeypatch):
    """The driver keeps a text of each plan; with the rank map as a literal such a text had over a million characters."""
    docs, plans = spark.createDataFrame([(1, "the end")], "doc_id bigint, text string"), []
    kind = type(docs)
    collect = kind.toArrow

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(kind, "toArrow", watched)
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    assert bpe.folded_words(docs, PATH, P.PATTERN)
    assert plans and all(len(x) < 100_000 for x in plans)

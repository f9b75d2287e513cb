import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalkiln.llm import token_store as S
from evalkiln.llm.common import shared_path

PATH = P.path("word_bpe_49k.json")


def check(rows, found):
    got = {(r.doc_id, r.ids_crc32): r for r in found}
    at, library = 0, Tokenizer.from_file(PATH)
    assert len(found) == len(rows)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        r = got[i, zlib.crc32(ids.tobytes())]
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for ids in ([0], [1, 49407, 2**31, 2**32 - 1, 77] * 900 + [5], [7] * 8):
        x = np.array(ids, np.uint32)
        assert (S.from_planes(S.to_planes(x, bits), len(x), bits) == x).all()
    assert S.to_planes(np.array([3, 4]), bits)[-1] == b""


@pytest.mark.parametrize("bits", [False, True])
def test_store_equals_the_library(spark, bits):
    rng = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "Word", "'s", "don't", "É", "é", " ́", "中文", "😀", "1234", "...", "\t", "x" * 100, " " * 200, "ΣΑΣ", "Σ ", "\r\n", "　", "<|endoftext|>", "<|EndOfText|>", "a<|startoftext|>b", "</w>", "İ", "ǅ"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(500, None), (501, ""), (502, "a" * 20_000), (None, "no id")]
    path = shared_path(spark, "test")
    S.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, PATH, bits=bits)
    check(rows, S.read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).collect())
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert index[0].start == 0 and all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:]))


def test_added_tokens_are_those_of_the_library(spark):
    encode = S.Encoder(PATH)
    for t in ("a <|endoftext|> b", "<|startoftext|>A B<|endoftext|>", "<|ENDOFTEXT|> x", "plain"):
        assert np.frombuffer(encode([t, "other"], 1)[0], "<u4").tolist() == Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids + [1]
    assert np.frombuffer(encode(["a <|endoftext|> b"], 1)[0], "<u4").tolist() == [320, 49407, 321, 1]


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, "same text of many rows")] * 900 + [(7, "one id")] * 60 + [(i, f"text {i}") for i in range(40)]
    path = shared_path(spark, "test")
    S.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), path, PATH, shards=10)
    got = S.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == 1000 and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(1000)]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 0.2 * sum(sizes)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, S.op4_token_store(spark, sf_dir).collect())


def test_edges(spark, edge_docs, no_docs):
    clash = edge_docs.withColumnsRenamed({"kept": "t", "score": "i"})
    for docs in (edge_docs, no_docs, clash):
        path = shared_path(spark, "test")
        S.write_tokens(docs, path, PATH)
        assert S.read_tokens(spark, path).count() == docs.count()

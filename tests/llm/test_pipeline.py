import hashlib

import corpus_pipeline as C
import public_tokenizers as P
import tiktoken
from evalkiln.llm import bpe

import test_decontaminate
import test_similar


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_bpe"]
    kept = []
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    first, unique, clean, redacted, last = ({r.doc_id: r for r in d.collect()} for d in kept)
    assert all(d.columns == kept[0].columns for d in kept[:4])
    groups = test_similar.brute_groups({i: r.text for i, r in first.items()})  # five-word shingles, 0.8
    assert set(unique) == {i for i in first if groups[i] == i}
    assert set(clean) == {i for i, r in unique.items() if not test_decontaminate.brute(r.text, items)[1]}
    assert set(redacted) == set(clean) == set(last)
    assert all(r.text == clean[i].text or "<" in r.text for i, r in redacted.items()) and all(r.n_chars == len(r.text) for r in redacted.values())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")).rank, special_tokens={})
    for i, r in last.items():
        ids = library.encode_ordinary(redacted[i].text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_rejections_and_odd_rows(spark, sf_dir):
    rows = [(1, "the of and in to is that", "en", "s", 24), (1, "the of and in to is that", "en", "s", 24), (2, None, None, None, None), (3, "12345 !!", "en", "s", 8), (None, "the of and in that to", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for n, (name, stage) in enumerate(C.STAGES):
        docs = C.written(stage(spark, docs, sf_dir), name)
        if n == 0:
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 1]
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1]
    # Columns of the operators' own names, and a very long text.
    long = "the of and in to is that it was for on as with he be at by " * 3000 + "token=abcdefghijkl"
    clash = spark.createDataFrame([(1, long, "en", "s", len(long), 1, 2, 3, 4), (2, "the of and in to", "en", "s", 16, 1, 2, 3, 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, kept int, score int, sid int")
    for name, stage in C.STAGES:
        clash = C.written(stage(spark, clash, sf_dir), name)
        assert name == "byte_bpe" or clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "kept", "score", "sid"]
        assert name != "secret_scans" or clash.where("doc_id = 1").first().text.endswith("at by <assign>")
    assert clash.count() == 2
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in C.STAGES:
        empty = C.written(stage(spark, empty, sf_dir), name)
    assert empty.count() == 0


def test_a_stage_lets_go_of_what_came_before(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "tidy", seen.append)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    for _, stage in C.STAGES:
        stage(spark, docs, sf_dir)
    assert len(seen) == len(C.STAGES)

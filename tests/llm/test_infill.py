import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from evalkiln.llm import infill

NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else (len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def test_equals_sql(spark, sf_dir):
    ours = infill.op12_fill_in_middle(spark, sf_dir).select(NAMES).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert sorted(map(tuple, ours)) == sorted(db.execute(f"SELECT {', '.join(NAMES)} FROM ({infill.op12_sql()})").fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in ours)


LONG = ["word 12 é\n" * 9000, "a" * 200_000 + " b", "𝔘é" * 50_000, "x" * infill.PART + "y", ("ab " * 21_845)[: infill.PART - 1] + "cd ef"]
MARKS = ["a <P> b", "<S>", "a<M", "a < S <", "<<P", "<S <P <M x", "P>S>M> y"]


@pytest.mark.parametrize("shift", [0, 1000, 2000])
def test_brute_force_and_restored(spark, shift):
    """Long texts, ends of marks beside cuts, and texts of one unit, each under several ids."""
    given = [(shift + i * 50 + j, t) for i, t in enumerate(LONG) for j in range(2)] + [(shift + 500 + i * 50 + j, t) for i, t in enumerate(MARKS) for j in range(20)]
    df = spark.createDataFrame(given, "doc_id bigint, text string")
    done = infill.fill_in_middle(df, keep=["doc_id", "text"]).select("*", infill.original(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(done) == len(given)
    for r in done:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == r.text
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_edges(spark, edge_docs, no_docs):
    clash = edge_docs.withColumnRenamed("score", "form").withColumnRenamed("kept", "n").withColumn("__key0", F.lit(1))
    done = infill.fill_in_middle(clash, keep=["doc_id", "text"]).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done], key=str) == sorted([(r.doc_id, *brute(r.doc_id, r.text)) for r in edge_docs.collect()], key=str)
    assert infill.fill_in_middle(no_docs).count() == 0


@pytest.mark.parametrize("part, short, known", [(infill.PART, infill.SHORT, infill.KNOWN), (20, 64, 50), (7, 3, 5), (1, 2, 1), (3, 0, 0)])
def test_words_and_parts_of_any_size(monkeypatch, part, short, known):
    """Spaces at both ends, beside each other and beside parts; words that are kept, forgotten and too long to keep."""
    for name, value in (("PART", part), ("SHORT", short), ("KNOWN", known)):
        monkeypatch.setattr(infill, name, value)
    chosen, units = random.Random(part), infill.Units()
    for i in range(2000):
        text = "".join(chosen.choice(chosen.choice(["ab", "  ", "aé𝔘\n", "abcdefgZ", "<SPM>", "12", "\0\r\t "])) for _ in range(chosen.randrange(60)))
        assert infill.transformed(text, hashlib.sha256(f"1:{i}".encode()).hexdigest(), units) == brute(i, text)


def test_a_word_is_split_once():
    """The pre-tokenizer's work is that of the distinct words, and of at most two words more for the places in each text."""

    class Counting:
        def __init__(self, split):
            self.split, self.seen = split, []

        def pre_tokenize_str(self, word):
            self.seen.append(word)
            return self.split.pre_tokenize_str(word)

    words, units = [f"word{i}, éa" for i in range(50)], infill.Units()
    units.split = Counting(units.split)
    texts = [" ".join(words[(i + j * (i % 7 + 1)) % 50] for j in range(500)) for i in range(100)]
    for i, text in enumerate(texts):
        assert infill.transformed(text, hashlib.sha256(f"1:{i}".encode()).hexdigest(), units) == brute(i, text)
    assert len(units.split.seen) <= 51 + 2 * len(texts)


def test_output_is_read_few_times(spark, edge_docs):
    """Restoring names the output seven times (69 before), and the workers give back no text that isn't asked for."""
    assert str(infill.original(F.col("output"), F.col("form"))).count("output") <= 7
    plan = infill.fill_in_middle(edge_docs)._jdf.queryExecution().executedPlan().toString()
    given = re.search(r"MapInArrow .*\[(.*)\]", plan)[1]
    assert "output" in given and "__text" not in given

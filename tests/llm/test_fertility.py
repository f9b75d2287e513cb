import math
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece

from evalkiln.llm import fertility as Q

PATH = P.path("piece_bpe_32k.model")


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(again)


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "a b c a b c", "x\nx\n\nx \n x", "é\xa0é # * $ % & | < >", "w " * 3000, "a b c d a b c e b c d"])
def test_base_counts_equal_brute_force(text):
    assert Q.measures(text, PATH)[:5] == brute(text)


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op10_quality_rules(spark, sf_dir).collect():
        n, chars, symbols, lines, again = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and not (r.kept and r.base_failed)


def brute_kept(rows):
    """id -> criteria outside their bands, from (id, text, lang): bands by sorting, level by level."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = {}
    for i, text, lang in rows:
        n, chars, _, _, again = brute(text)
        ids = model.encode(text or "")
        share = [c / len(ids) for c in Counter(ids).values()]
        values = (len(text) / len(ids), sum(map(model.is_byte, ids)) / len(ids), -sum(p * math.log2(p) for p in share)) if ids else (0.0, 0.0, 0.0)
        found[i] = (n, chars, Q.script_of(text or ""), lang, tuple(round(v, 9) for v in values), n < 50 or 100 * again > 50 * n)
    groups = {}
    for n, chars, script, lang, values, failed in set(found.values()):
        if not failed:
            for level in {(script, lang), (script, None), (None, None)}:
                groups.setdefault(level, []).append(values)
    least, reach, slack = (0.01, 0.002, 0.05), ((12, 8), (None, 10), (12, 3.5)), (0, 0.05, 0)

    def spread(own, k):
        own = sorted(v[k] for v in own)
        q = [own[max(0, math.ceil(i / 200 * len(own)) - 1)] for i in range(201)]
        width, i = min((q[i + 100] - q[i], i) for i in range(101))
        return (q[i] + q[i + 100]) / 2, max(width / (2 * 0.6744897501960817) * (1 + 5 / len(own)), least[k])

    limits = {}
    for level, own in groups.items():
        first = [spread(own, k) for k in range(3)]
        own = [v for v in own if all(abs(v[k] - first[k][0]) <= 3.5 * first[k][1] for k in range(3))]
        if own:
            limits[level] = len(own), [(c - reach[k][0] * s - slack[k] if reach[k][0] else 0.0, c + reach[k][1] * s + slack[k]) for k in range(3) for c, s in [spread(own, k)]]
    out = {}
    for i, (n, _, script, lang, values, failed) in found.items():
        bad = []
        for k, name in enumerate(("chars_per_token", "byte_share", "token_entropy")):
            low, high = getattr(Q.BANDS.get(script, Q.BANDS["other"]), name)
            for level in [(None, None), (script, None), *([(script, lang)] if lang is not None else [])]:
                many, own = limits.get(level, (0, [(low, high)] * 3))
                low, high = (end + many / (many + 20) * (mine - end) for end, mine in zip((low, high), own[k]))
            if n and not low - 1e-6 <= values[k] <= high + 1e-6:
                bad.append(name)
        out[i] = (",".join(bad), not failed and not bad, values)
    return out


def noise():
    """Letters at random, code points at random, bytes read as Latin letters, loops of three words; 60 words and more each."""
    rng = random.Random(1)
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9)))
    low = "abcdefghijklmnopqrstuvwxyz"
    kinds = [low, low.upper(), "".join(map(chr, range(0x4E00, 0x9FFF))), "".join(map(chr, range(0xC0, 0x180))), "".join(map(chr, range(33, 127)))]
    return [" ".join(word(k) for _ in range(300)) for k in kinds] + [" ".join(chr(0x2800 + rng.randint(0, 200)) * 3 for _ in range(80))]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The documents of the 0.01 table, with noise, a text of which there are very many copies, and null languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    clean = {i for i, _, _ in rows}
    rows += [(10_000 + i, t, "en") for i, t in enumerate(noise())] + [(20_000 + i, rows[5][1], "en") for i in range(300)] + [(30_000, rows[7][1], None), (30_001, None, "en"), (30_002, "", None)]
    path = tmp_path_factory.mktemp("fertility")
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows, clean


def test_query_equals_brute_force_with_bands(spark, table):
    path, rows, _ = table
    want = brute_kept(rows)
    got = Q.op10_quality_rules(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        outside, kept, values = want[r.doc_id]
        assert (r.outside, r.kept) == (outside, kept), r
        assert all(abs(a - b) < 1e-6 for a, b in zip((r.chars_per_token, r.byte_share, r.token_entropy), values))


def test_bands_reject_noise_and_leave_clean_texts(spark, table):
    path, rows, clean = table
    got = Q.op10_quality_rules(spark, path).collect()
    assert all(not r.kept for r in got if 10_000 <= r.doc_id < 10_000 + len(noise()))
    assert sum(bool(r.outside) and not r.base_failed for r in got if r.doc_id in clean) <= 0.01 * len(clean)
    counts = {r.rule: r.texts for r in Q.rejections(Q.op10_quality_rules(spark, path)).collect()}
    assert set(counts) == {"base", *Q.CRITERIA} and counts["chars_per_token"] >= 3


def test_fixed_bands_where_there_are_few_texts(spark):
    prose = "In the morning the old keeper climbed the tower, wrote the wind and the height of the sea in his book, and looked for ships that had left the harbour the day before. " * 2
    few = " ".join(["ab", "ba"][(i * i) % 7 % 2] for i in range(90))
    rows = [(1, prose), (2, " ".join(chr(0x2800 + i % 200) * 3 for i in range(80)) + " x"), (3, few), (4, None)]
    found = {r.doc_id: r for r in Q.measure(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()}
    assert found[1].outside == "" and not found[3].kept and not found[4].kept and found[4].base_failed


def test_scripts():
    assert [Q.script_of(t) for t in ("abc", "λόγος", "слово", "漢字漢字", "ひらがな", "한국어", "123", "")] == ["latin", "greek", "cyrillic", "han", "kana", "hangul", "other", "other"]


def test_edges(spark, edge_docs, no_docs):
    clash = edge_docs.withColumnsRenamed({"kept": "band", "score": "exact"})
    assert {"band", "exact"} <= set(Q.measure(clash, PATH).columns) and Q.measure(clash, PATH).count() == edge_docs.count()
    out = Q.measure(edge_docs.drop("kept"), PATH)
    assert out.count() == edge_docs.count() and out.where("text is null").first().n_words == 0
    assert Q.measure(edge_docs, PATH).count() == edge_docs.count() and Q.measure(no_docs, PATH).count() == 0


@pytest.fixture(scope="module")
def english(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang").collect()
    return [(r.doc_id, r.text, r.lang) for r in docs if r.text]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.2, 0.4])
def test_noise_widens_no_band(spark, english, share):
    """Letters at random under the label of clean texts: all are rejected whatever their share, and clean texts stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    clean = [r for r in english if brute(r[1])[0] >= 50][:200]
    rows = clean + [(100_000 + i, " ".join(word() for _ in range(300)), "en") for i in range(int(len(clean) * share / (1 - share)))]
    got = Q.measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), PATH).collect()
    assert not [r.doc_id for r in got if r.doc_id >= 100_000 and r.kept]
    assert sum(bool(r.outside) for r in got if r.doc_id < 100_000) <= 0.01 * len(clean)


def test_bands_follow_the_number_of_texts(spark, english):
    """One text more or less moves a limit a little, at any size of a group."""
    clean = [r for r in english if brute(r[1])[0] >= 50]
    limit = lambda n: {r.lang: r.band for r in Q.fitted_bands(Q.measure(spark.createDataFrame(clean[:n], "doc_id bigint, text string, lang string"), PATH)).collect()}["en"].chars_per_token.least
    a, b = limit(99), limit(100)
    assert abs(a - b) < 0.1

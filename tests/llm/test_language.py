import math
import random
import re
import zlib
from collections import Counter

from evalkiln.llm import language as L


def test_held_out_accuracy(spark):
    rows = L.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


TRAIN = [(i, "the cat sat on the mat", "en") for i in range(5)] + [(10 + i, "die katze lag auf der matte", "de") for i in range(5)] + [(99, "no label", None), (98, None, "en")]


def model(spark):
    return L.train(spark.createDataFrame(TRAIN, "doc_id bigint, text string, lang string"))


def test_known_words_and_backoff(spark):
    m = model(spark)
    assert m.languages == ["de", "en"]
    assert m.predict("The cat")[0] == "en" and m.predict("matte")[0] == "de"
    assert m.knows("matte") and not m.knows("katzen") and m.predict("katzen")[0] == "de"  # by its 5-grams
    assert m.predict("zzkazz")[0] in ("de", "en")
    assert m.predict(None) == m.predict("") == m.predict("123 !?") == m.predict("²") == ("und", 0.0)


def brute(texts, sample):
    """The backoff rule word by word, with dictionaries of strings, over (text, language) rows."""
    find = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: [e[i : i + n] for e in [f"^{w}$" if n > 1 else w] for i in range(len(e) - n + 1)]
    languages = sorted({lang for _, lang in sample})
    counts = {n: {lang: Counter() for lang in languages} for n in range(6)}
    for text, lang in sample:
        for w in find(text):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams(w, n))
    known = {n: set().union(*counts[n].values()) for n in counts}
    total = {n: {x: counts[n][x].total() for x in languages} for n in counts}
    log = lambda n, x, g: math.log((counts[n][x][g] + 0.5) / (total[n][x] + 0.5 * len(known[n])))
    for text in texts:
        sums = dict.fromkeys(languages, 0.0)
        for w in find(text or ""):
            for n in (0, 5, 4, 3, 2, 1):
                own = [g for g in ([w] if n == 0 else grams(w, n)) if g in known[n]]
                if own:
                    for x in languages:
                        sums[x] += sum(log(n, x, g) for g in own) / len(own)
                    break
        yield ("und", 0.0) if not any(c.isalpha() for c in text or "") else max(((x, 1 / sum(math.exp(y - s) for y in sums.values())) for x, s in sums.items()), key=lambda p: (p[1], [-ord(c) for c in p[0]]))


def test_equals_brute_force_with_many_languages(spark):
    """Every label, word and n-gram counts: 30 languages, most of them with few documents."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäéßøñçжыαωΣ漢字"
    words = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(12)] for k in range(30)}
    sample = [(" ".join(rng.choice(own) for _ in range(20)), lang) for lang, own in words.items() for _ in range(1 + 5 * (lang == "l00"))]
    m = L.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(sample)], "doc_id bigint, text string, lang string"))
    assert len(m.languages) == 30
    texts = [" ".join(rng.choice(words[rng.choice(list(words))]) for _ in range(rng.randint(1, 4))) + rng.choice(["", " zq", "x", "İ", "ΑΣ"]) for _ in range(150)] + [None, "", "12", "_", "²"]
    for text, got, (lang, score) in zip(texts, zip(*m.predict_all(texts)), brute(texts, sample)):
        assert abs(got[1] - score) < 1e-4 and (got[0] == lang or abs(score - 1 / 2) < 0.01 or score < 0.2), text


def test_ties_go_to_the_first_language(spark):
    m = L.train(spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id bigint, text string, lang string"))
    assert m.predict("same words")[0] == "a" and abs(m.predict("same words")[1] - 0.5) < 1e-9


def test_long_texts_are_read_to_the_end(spark, monkeypatch):
    m = model(spark)
    text = "the cat " * 50 + "die katze " * 60
    whole = m.predict(text)
    monkeypatch.setattr(L, "CHARS", 64)
    cut = m.predict(text)
    assert whole[0] == cut[0] == "de" and abs(whole[1] - cut[1]) < 1e-9


def test_edges(spark, edge_docs, no_docs):
    m = model(spark)
    out = L.identify(edge_docs, m)
    assert out.count() == edge_docs.count() and "kept" in out.columns and "text" in out.columns
    assert out.where("text is null").first().lang_pred == "und"
    assert L.identify(no_docs, m).count() == 0
    nothing = L.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in L.identify(edge_docs, nothing).collect()} == {"und"}

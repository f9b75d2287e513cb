import hashlib
import math
import random
import re
from collections import Counter

import regex

from pyspark.sql import functions as F

from evalkiln.llm import pii
from evalkiln.llm.spans import digest


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only(m):
    return re.sub("[^0-9]", "", m)


BRUTE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
]
PIECES = ["a@b.c", "@", ".", "x_y", "-", "1", "22", "255", ".256", "00", "+1 (555) 010-9999", "4111 1111 1111 1111", "378282246310005", " ", "é😀", "192.168.0.1", "%", "foo.bar+x@mail.example.com", "\n", "(", "hello", "10.0", ".0.1"]


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BRUTE for m in re.finditer(p, text or "") if ok(m[0]))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))) for i in range(600)]
    rows += [(9000, None), (9001, ""), (9002, "1" * 5000), (9003, "1 " * 5000), (9004, "a" * 50_000), (9005, "a@b" + ".c" * 5000), (9006, "x@y.zz " * 1000), (9007, "1.2.3.4." * 1000)]
    found = pii.scan_pii(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["doc_id"]).select("doc_id", digest(F.col("base_spans")).alias("b")).collect()
    texts = dict(rows)
    assert len(found) == len(rows) and all(r.b == brute(texts[r.doc_id]) for r in found)


def names(n):
    """Documents where one name stands near one address, and many clean ones."""
    rows = [(i, f"Note {i}: Zorblat writes to bob.smith@acme.org about things, number{i}") for i in range(n)]
    return rows + [(100 + i, f"other words here about things and to writes, line {i}") for i in range(60)]


def test_disclosing_terms_are_found_and_clean_texts_left(spark):
    rows = names(6) + [(500, None), (501, ""), (502, names(6)[0][1])]
    found = {r.doc_id: r for r in pii.scan_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    added = {texts[0][s.start : s.stop] for s in found[0].added_spans}
    assert added == {"Zorblat", "Note"}  # both stand nowhere else; "writes" and "things" do
    assert all(not found[i].added_spans and not found[i].base_spans for i in range(100, 160))
    assert found[502].added_spans == found[0].added_spans and not found[500].added_spans


def brute_added(texts, min_texts=3):
    """id -> added spans by the definition, pair by pair over whole documents."""
    letters = lambda t: [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"(?<![\p{L}\p{N}\p{M}])[\p{L}\p{N}\p{M}]+", t or "") if regex.search(r"\p{L}", m[0])]
    entities = lambda t: {(k, m[0].lower() if k == "email" else re.sub("[^0-9.]", "", m[0])) for k, p, ok in BRUTE for m in re.finditer(p, t or "") if ok(m[0])}
    words = {i: {w for *_, w in letters(t)} for i, t in texts.items()}
    held = {i: entities(t) for i, t in texts.items()}
    n_term, flagged = Counter(w for ws in words.values() for w in ws), {}
    for e in set().union(*held.values()):
        docs = [i for i in texts if e in held[i]]
        ic = math.log2(max(len(texts) / len(docs), 1.0000001))
        for w in set().union(*(words[i] for i in docs)):
            both = [i for i in docs if w in words[i]]
            if len({texts[i] for i in both}) >= min_texts:
                d = 1 + math.log2(len(both) / n_term[w]) / ic
                if d >= 0.8:
                    for i in both:
                        flagged[i, w] = max(flagged.get((i, w), 0), 5 if d >= 0.95 else 4)
    out = {}
    for i, t in texts.items():
        base = [m.span() for k, p, ok in BRUTE for m in re.finditer(p, t or "") if ok(m[0])]
        out[i] = [(flagged[i, w], a, b) for a, b, w in letters(t) if (i, w) in flagged and not any(x < b and a < y for x, y in base)]
    return out


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(8)
    people = [(n, f"{n.lower()}@x{i}.org", f"+1 555 010 {1000 + i}") for i, n in enumerate(["Li", "Zorblat", "Ann", "Ülker", "王芳", "Bo", "Xu2"])]
    common = "the a of note about things to writes from and 10 x été".split()
    texts = {}
    for i in range(160):
        own = [rng.choice(common) for _ in range(rng.randint(3, 40))]
        if i % 2:
            name, mail, phone = people[i % 13 % len(people)]
            own = [name, *own, rng.choice([mail, phone, mail.upper()]), *own[:2], *([name] if i % 3 else [])]
        if i % 5 == 0:
            own.append(rng.choice([p[0] for p in people[:3]]))
        texts[i] = " ".join(own) if i % 40 else None
    texts |= {1000 + i: texts[3] for i in range(9)}
    want = brute_added(texts)
    found = {r.doc_id: [(s.rank, s.start, s.stop) for s in r.added_spans] for r in pii.scan_pii(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert found == want
    marked = {texts[i][a:b] for i, x in want.items() for _, a, b in x}
    assert {"Ülker", "Xu2"} <= marked and {r for x in want.values() for r, _, _ in x} == {4, 5}


def test_short_and_distant_names_are_found(spark):
    """A name of two letters in the heading, far from the address, is marked in every place."""
    rows = [(i, f"Li 王芳\n{'word ' * (40 + i)}\nwrite to li@acme.org, or ask Li") for i in range(6)] + [(50 + i, f"word {i} to ask or write") for i in range(60)]
    found = {r.doc_id: r for r in pii.scan_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [rows[0][1][s.start : s.stop] for s in found[0].added_spans] == ["Li", "王芳", "Li"]


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_added(texts)
    rows = pii.op3_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone"))
        assert r.spans == ",".join(filter(None, [base, *(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want[r.doc_id])]))


def test_hot_text_and_list_of_addresses(spark):
    """Copies of one text are most rows; near copies of a long list cost classes, not pairs."""
    many = " ".join(f"u{i}@h{i}.net w{i}" for i in range(400))
    rows = [(i, "same text bob@acme.org here") for i in range(3000)] + [(9000 + i, f"{many} v{i}") for i in range(4)]
    found = {r.doc_id: r for r in pii.scan_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(found) == len(rows) and not found[0].added_spans and len(found[9000].added_spans) == 400


def test_too_little_evidence_adds_nothing(spark):
    found = pii.scan_pii(spark.createDataFrame(names(2) + [(50, names(2)[0][1])] * 5, "doc_id bigint, text string")).collect()
    assert not any(r.added_spans for r in found)


def test_sanitise(spark, edge_docs, no_docs):
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(names(6) + [(200, None)], "doc_id bigint, text string")).collect()}
    assert "bob.smith" not in out[0] and "<email>" in out[0] and "Zorblat" not in out[0] and out[200] is None
    assert out[100] == dict(names(6))[100]
    assert pii.sanitise(edge_docs).exceptAll(edge_docs).count() == 0
    assert pii.sanitise(no_docs).count() == 0

"""Personal data with built-in functions only: patterns, and terms that give the protected entities away.

The patterns find the protected entities of a text (addresses, numbers). Masking them is not enough where other
words of the text reveal them, so the corpus is asked: with p(e) the share of documents that hold entity e, p(t) the
share that hold term t and p(e, t) the share that hold both, the disclosure of e by t is

    PMI(e; t) / IC(e) = log(p(e, t) / (p(e) p(t))) / -log p(e),

1 if t never occurs without e, 0 if they are independent. A term that discloses more than ``remove_at`` of an entity
is removed wherever it stands in the texts that hold the entity, one that discloses more than ``generalise_at`` is
generalised to a placeholder. Terms are words of any length: what is short is common, and the counts say so. As an
estimate needs evidence, the pair has to be seen in ``min_texts`` different texts.

Pairs are kept few without loss. A term in n_t documents can't reach a disclosure g of an entity in n_e of N unless
n_t <= n_e (N / n_e)^(1 - g), so common words meet no entity. And entities (or terms) that stand in exactly the same
texts are one class, so a long list of addresses in some near copies costs one pair, not the square of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalkiln.llm.common import join_groups, small_batches, written
from evalkiln.llm.spans import digest, let, merged, replaced, spans_of

#: The base patterns. Possessive loops and the looks behind change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A term is a run of letters, marks and digits with a letter, of any length.
TERM = r"(?<![\p{L}\p{N}\p{M}])(?=[\p{N}\p{M}]*\p{L})[\p{L}\p{N}\p{M}]++"
PLACES = "array<struct<rank:int,start:int,stop:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """Base spans with their matches, by kind as listed, then place: array of (rank, start, stop, kind, match)."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    card = lambda s: let(digits(s["match"]), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    parts = (
        spans_of(text, EMAIL),
        F.filter(spans_of(text, IP), lambda s: s["match"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        F.filter(spans_of(text, CARD), card),
        F.filter(spans_of(text, PHONE), lambda s: F.length(digits(s["match"])).between(9, 15)),
    )

    def of_kind(rank: int) -> Column:
        return F.transform(parts[rank], lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(KINDS[rank]).alias("kind"), s["match"].alias("match")))

    return F.concat(*[of_kind(rank) for rank in range(len(parts))])


def _entities(base: Column) -> Column:
    """Hashes of the entities of a text: addresses in lower case, numbers by their digits and points."""
    name = lambda s: F.when(s["kind"] == "email", F.lower(s["match"])).otherwise(F.regexp_replace(s["match"], "[^0-9.]", ""))
    return F.array_distinct(F.transform(base, lambda s: F.xxhash64(s["kind"], name(s))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def _same_texts(name: str) -> list[Column]:
    """The number of texts, and two hashes of which they are."""
    return [F.count("*").alias("texts"), F.bit_xor(F.xxhash64("key")).alias(f"{name}1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias(f"{name}2")]


def disclosing(texts: DataFrame, all_terms: DataFrame, n_docs: int, min_texts: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(key, h, gone): terms that disclose an entity of the text ``key``; ``gone`` if they are to be removed.

    ``texts`` has the different texts with an entity: key, n (documents), es and hs (hashes of entities and terms);
    ``all_terms`` has h and n_term (documents of the whole corpus with the term).
    """
    held = texts.select("key", "n", F.explode("es").alias("e"))
    entities = held.groupBy("e").agg(*_same_texts("e"), F.sum("n").alias("n_e")).where(F.col("texts") >= min_texts)
    entities = written(entities.select("e", "texts", "n_e", F.xxhash64("e1", "e2", "texts").alias("ec")), "pii-entities")
    of_text = written(join_groups(held, entities, "e", "texts").where("ec is not null").select("key", "n", "ec", "n_e").distinct(), "pii-held")

    most = entities.agg(F.max("n_e")).first()[0] or 0
    reach = lambda n_e: n_e * F.pow(F.lit(float(n_docs)) / n_e, F.lit(1 - generalise_at)) * (1 + 1e-9)
    words = texts.join(of_text.select("key").distinct(), "key", "left_semi").select("key", F.explode("hs").alias("h"))
    terms = words.groupBy("h").agg(*_same_texts("t")).where(F.col("texts") >= min_texts)
    terms = terms.join(all_terms.where(F.col("n_term") <= reach(F.lit(float(max(most, 1))))), "h")
    terms = written(terms.select("h", "texts", "n_term", F.xxhash64("t1", "t2", "texts", "n_term").alias("tc")), "pii-terms")
    in_text = written(join_groups(words, terms, "h", "texts").where("tc is not null").select("key", "h", "tc", "n_term"), "pii-words")

    met = of_text.join(in_text.select("key", "tc", "n_term").distinct(), "key").where(F.col("n_term") <= reach(F.col("n_e")))
    pairs = met.groupBy("ec", "tc", "n_e", "n_term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_both")).where(F.col("texts") >= min_texts)
    ratio = 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / F.log2(F.greatest(F.lit(float(n_docs)) / F.col("n_e"), F.lit(1.0000001)))
    flagged = pairs.withColumn("disclosure", ratio).where(F.col("disclosure") >= generalise_at).select("ec", "tc", (F.col("disclosure") >= remove_at).alias("gone"))
    found = of_text.select("key", "ec").join(flagged, "ec").groupBy("key", "tc").agg(F.max("gone").alias("gone"))
    return found.join(in_text.select("key", "tc", "h"), ["key", "tc"]).select("key", "h", "gone")


def scan_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_texts: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with base_spans and added_spans.

    base_spans: array of (rank, start, stop, kind, match) by kind, then place; added_spans: array of (rank, start,
    stop, kind), every occurrence of a term that discloses an entity of the text, none of them touching a base span.
    Null text counts as empty. Equal texts are judged together and count as one text of evidence, whatever their
    number; repeated rows stay. Columns of the same names are replaced, others may have any name. Counts are taken
    over all rows and whole texts.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "added_spans")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), text.alias("t"))
    df = df.withColumn("base", base_spans(F.col("t")))
    only = lambda c: F.when(F.size("base") > 0, c)
    found = written(df.select("kept", "base", only(F.md5("t")).alias("key"), only(F.col("t")).alias("t"), only(_entities(F.col("base"))).alias("es"), only(_terms(F.col("t"))).alias("hs")), "pii")

    with_entity = found.where("key is not null")
    texts = written(with_entity.groupBy("key").agg(F.count("*").alias("n"), F.first("es").alias("es"), F.first("hs").alias("hs")), "pii-texts")
    all_terms = docs.select(F.explode(_terms(text)).alias("h")).groupBy("h").agg(F.count("*").alias("n_term"))
    terms = disclosing(texts, all_terms, docs.count(), min_texts, generalise_at, remove_at)
    one = lambda c: F.collect_list(F.when(c, F.col("h")))
    by_text = terms.groupBy("key").agg(one(F.col("gone")).alias("gone"), one(~F.col("gone")).alias("general"))
    rows = join_groups(with_entity.select("key", "kept", "base", "t"), written(texts.select("key", "n").join(by_text, "key", "left"), "pii-flags"), "key", "n")

    def places(spans: Column) -> Column:
        ranked = F.transform(spans, lambda s: let(F.xxhash64(F.lower(s["match"])), lambda h: F.struct(F.when(F.array_contains("gone", h), KINDS.index("remove")).when(F.array_contains("general", h), KINDS.index("generalise")).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"))))
        apart = F.filter(F.filter(ranked, lambda a: a["rank"].isNotNull()), lambda a: ~F.exists("base", lambda b: (b["start"] < a["stop"]) & (a["start"] < b["stop"])))
        return F.transform(apart, lambda a: F.struct(a["rank"].alias("rank"), a["start"].alias("start"), a["stop"].alias("stop"), F.when(a["rank"] == KINDS.index("remove"), "remove").otherwise("generalise").alias("kind")))

    nothing = F.array().cast(PLACES)
    added = F.when(F.size("gone") + F.size("general") > 0, places(spans_of(F.col("t"), TERM))).otherwise(nothing)
    out = found.where("key is null").select("kept", "base", nothing.alias("added")).union(rows.select("kept", "base", added.alias("added")))
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("base").alias("base_spans"), F.col("added").alias("added_spans"))


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with entities replaced by ``<kind>``, disclosing terms by ``<term>`` or nothing.

    Rows and other columns stay, whatever their names; repeated rows agree; null text stays null.
    """
    columns = docs.columns
    found = scan_pii(docs.select(F.struct(*columns).alias("__row"), F.col(text_col).alias("__text")), "__text", keep=["__row", "__text"], **options)
    places = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    mark = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "<term>").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
    clean = replaced(F.col("__text"), merged(F.array_sort(F.concat(places(F.col("base_spans")), places(F.col("added_spans"))))), mark)
    return found.select(*[(F.when(F.col("__text").isNotNull(), clean) if c == text_col else F.col("__row")[c]).alias(c) for c in columns])


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = digest(F.col("base_spans"))
    return found.select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(base, digest(F.col("added_spans"))), lambda x: x != ""), ",").alias("spans"),
    )

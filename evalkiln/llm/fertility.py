"""Quality rules from tokeniser fertility.

A public vocabulary says how well it knows a text: characters per token (few, if words fall apart), the share of
tokens that are single fallback bytes, and the Shannon entropy of the token distribution (low for repetitive text,
high for random characters). Each has a band per language or script, fitted on the corpus itself. Centre and spread of
a group are those of the shortest interval that holds half of its texts (different ones that pass the plain counts),
which up to half of the texts being noise cannot move away; then texts far from it are left out and both are
taken again, so that noise widens no band either. A band reaches REACH spreads down and up. Few texts say little: the
limits of script and language are drawn towards those of the script, these towards those of all texts, and these towards
the fixed ``BANDS``, by PRIOR texts each time, so nothing changes suddenly with the size of a group. Plain counts come first: too few words, or mostly repeated
three-word windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from evalkiln.llm.common import filled, restored, small_batches, written

#: Fixed values of the base rule.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


#: How far a band reaches from its centre, down and up, in spreads, and beyond that; a spread is at least LEAST.
REACH = {"chars_per_token": (12.0, 8.0), "byte_share": (math.inf, 10.0), "token_entropy": (12.0, 3.5)}  # no text has too few fallback bytes
SLACK = {"chars_per_token": 0.0, "byte_share": 0.05, "token_entropy": 0.0}
LEAST = {"chars_per_token": 0.01, "byte_share": 0.002, "token_entropy": 0.05}
CRITERIA = tuple(SLACK)
#: Texts farther from the first centre, in spreads, don't take part in the second fit.
TRIM = 3.5
#: Texts that what is known beforehand weighs as much as.
PRIOR = 20
#: Quantiles among which the shortest half is looked for, and its half width in standard deviations of a normal sample.
STEPS, HALF_WIDTH = 200, 0.6744897501960817
#: Bands (scripts and labels) that may be broadcast.
MANY_BANDS = 10_000


@dataclass(frozen=True)
class Band:
    """What is accepted where too few texts were seen: characters per token, fallback bytes and entropy, each (least, most)."""

    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    token_entropy: tuple[float, float]


#: By dominant script. The vocabulary is made for Latin text; it spells others in short pieces or bytes.
BANDS = {
    "latin": Band((1.5, 9.0), (0.0, 0.15), (4.5, 14.0)),
    "greek": Band((0.6, 6.0), (0.0, 0.60), (4.0, 14.0)),
    "cyrillic": Band((0.8, 7.0), (0.0, 0.40), (4.0, 14.0)),
    "han": Band((0.25, 3.0), (0.0, 0.95), (4.0, 14.0)),
    "kana": Band((0.3, 3.0), (0.0, 0.95), (4.0, 14.0)),
    "hangul": Band((0.25, 3.0), (0.0, 0.98), (4.0, 14.0)),
    "other": Band((0.2, 9.0), (0.0, 0.99), (3.0, 14.0)),
}
#: Code point ranges of the scripts told apart; letters elsewhere are "other".
_SCRIPTS = {
    "latin": "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ",
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯ",
    "han": "㐀-䶿一-鿿",
    "kana": "぀-ヿ",
    "hangul": "가-힯ᄀ-ᇿ",
    "arabic": "\u0600-\u06ff\u0750-\u077f",
    "hebrew": "\u0590-\u05ff",
    "devanagari": "\u0900-\u097f",
    "bengali": "\u0980-\u09ff",
    "tamil": "\u0b80-\u0bff",
    "thai": "\u0e00-\u0e7f",
    "georgian": "\u10a0-\u10ff",
    "armenian": "\u0530-\u058f",
}
_RUNS = {name: re.compile(f"[{ranges}]+") for name, ranges in _SCRIPTS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first as listed, texts without letters to ``other``."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "other"
    size = {name: sum(map(len, p.findall(text))) for name, p in _RUNS.items()}
    size["other"] = sum(map(len, _LETTERS.findall(text))) - sum(size.values())
    return max(size, key=size.get) if any(size.values()) else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more, its first place included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, back, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[back] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum())


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def measures(text: str | None, path: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, script, chars per token, byte share, entropy."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    base = (len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))
    model, is_byte = _vocabulary(path)
    ids = np.array(model.encode(text, num_threads=1), np.int64)
    if not len(ids):
        return (*base, script_of(text), 0.0, 0.0, 0.0)
    n = np.bincount(ids)
    share = n[n > 0] / len(ids)
    return (*base, script_of(text), len(text) / len(ids), float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum()))


COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "script": "string", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double"}


def _spreads(rows: DataFrame) -> DataFrame:
    """(script, lang, n, and centre and spread of each criterion): of the shortest half of each group."""
    steps = [F.percentile_approx(c, [i / STEPS for i in range(STEPS + 1)], 10_000).alias(c) for c in CRITERIA]
    found = rows.groupBy("script", "lang").agg(F.count("*").alias("n"), *steps)

    def shortest(c: str):
        half = STEPS // 2
        at = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(half)), lambda i: F.struct((F.get(c, i + half) - F.get(c, i)).alias("width"), i.alias("i"))))
        low, high = F.get(c, at["i"]), F.get(c, at["i"] + half)
        return F.struct(((low + high) / 2).alias("centre"), F.greatest(at["width"] / (2 * HALF_WIDTH) * (1 + 5.0 / F.col("n")), F.lit(LEAST[c])).alias("spread")).alias(c)

    return found.select("script", "lang", "n", *[shortest(c) for c in CRITERIA])


def fitted_bands(measured: DataFrame) -> DataFrame:
    """(script, lang, n, band): least and most of each criterion for all texts (null script), each script (null lang), and each script and language."""
    different = measured.where(~F.col("base_failed")).select("n_words", "word_chars", "script", "lang", *CRITERIA).distinct()
    group = lambda script, lang: F.struct(script.cast("string").alias("script"), lang.cast("string").alias("lang"))
    levels = F.array(group(F.col("script"), F.col("lang")), group(F.col("script"), F.lit(None)), group(F.lit(None), F.lit(None)))
    rows = different.withColumn("level", F.explode(F.array_distinct(levels))).select("level.*", *CRITERIA)
    first = written(_spreads(rows).select(F.col("script").alias("s"), F.col("lang").alias("l"), *[F.col(c).alias(f"own_{c}") for c in CRITERIA]), "spreads")
    if first.count() <= MANY_BANDS:
        first = F.broadcast(first)
    near = [F.abs(F.col(c) - F.col(f"own_{c}")["centre"]) <= TRIM * F.col(f"own_{c}")["spread"] for c in CRITERIA]
    left = rows.join(first, F.col("script").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l"))).where(near[0] & near[1] & near[2])
    low = lambda c: F.col(c)["centre"] - REACH[c][0] * F.col(c)["spread"] - SLACK[c] if math.isfinite(REACH[c][0]) else F.lit(0.0)
    high = lambda c: F.col(c)["centre"] + REACH[c][1] * F.col(c)["spread"] + SLACK[c]
    return _spreads(left).select("script", "lang", "n", F.struct(*[F.struct(low(c).alias("least"), high(c).alias("most")).alias(c) for c in CRITERIA]).alias("band"))


def measure(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with COLUMNS, base_failed, outside and kept.

    ``outside`` names the criteria whose band the text leaves, comma-joined; kept is false for it and where the plain
    counts fail. ``vocabulary`` is the path of a sentencepiece model with byte fallback that every executor can read.
    Null text has no words and fails, as does empty text. Each text is measured whole; repeated rows agree and count
    once for the bands. A null or missing language is "any". Columns of the same names are replaced, others may have
    any name. The measured rows are written in the shared folder, as they are read twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = ("base_failed", "outside", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*COLUMNS, *new)]
    rest = [c for c in keep if c != text_col]
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    df = docs.select(F.struct(*rest).alias("kept") if rest else F.lit(None).cast("int").alias("kept"), F.col(text_col).alias("__text"), lang.alias("lang"))
    fields = ["kept", "lang", *(["__text"] if text_col in keep else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            got = pd.DataFrame([measures(x, vocabulary) for x in pdf["__text"]], columns=list(COLUMNS))
            yield pd.concat([pdf[fields].reset_index(drop=True), got], axis=1)

    out = df.mapInPandas(run, df.select(*fields).withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items()}).schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = written(out.withColumn("base_failed", failed), "fertility")

    bands = written(fitted_bands(out), "bands")  # one row for each script and label
    few = F.broadcast if bands.count() <= MANY_BANDS else lambda df: df
    exact = few(bands.where("lang is not null").select("script", "lang", F.struct("n", "band").alias("exact")))
    wide = F.broadcast(bands.where("lang is null and script is not null").select("script", F.struct("n", "band").alias("wide")))  # one for each script
    whole = F.broadcast(bands.where("script is null").select(F.struct("n", "band").alias("whole")))  # one row
    pair = lambda x: F.struct(F.lit(x[0]).alias("least"), F.lit(x[1]).alias("most"))
    fixed = F.coalesce(*[F.when(F.col("script") == s, F.struct(*[pair(getattr(b, c)).alias(c) for c in CRITERIA])) for s, b in BANDS.items()], F.struct(*[pair(getattr(BANDS["other"], c)).alias(c) for c in CRITERIA]))

    def drawn(own, parent):
        """The limits of a group, drawn towards those of what it is part of."""
        share = F.coalesce(own["n"], F.lit(0)) / (F.coalesce(own["n"], F.lit(0)) + PRIOR)
        limit = lambda c, end: (parent[c][end] + share * F.coalesce(own["band"][c][end] - parent[c][end], F.lit(0.0))).alias(end)
        return F.struct(*[F.struct(limit(c, "least"), limit(c, "most")).alias(c) for c in CRITERIA])

    out = out.join(exact, ["script", "lang"], "left").join(wide, "script", "left").join(whole, F.lit(True), "left")
    out = out.withColumn("band", drawn(F.col("whole"), fixed))
    for level in ("wide", "exact"):
        out = out.withColumn("band", drawn(F.col(level), F.col("band")))
    outside = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).between(F.col("band")[c]["least"], F.col("band")[c]["most"]), c) for c in CRITERIA])), ",")
    out = out.withColumn("outside", F.when(F.col("n_words") > 0, outside).otherwise("")).withColumn("verdict", ~F.col("base_failed") & (F.col("outside") == ""))
    return restored(out, text_col, keep, *COLUMNS, "base_failed", "outside", "verdict").withColumnRenamed("verdict", "kept")


def rejections(measured: DataFrame) -> DataFrame:
    """(rule, texts): how many rows the plain counts and each criterion reject; a row may count for several criteria."""
    rules = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.split("outside", ","))
    return measured.select(F.explode(rules).alias("rule")).where("rule <> ''").groupBy("rule").agg(F.count("*").alias("texts"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = measure(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *CRITERIA, "outside")

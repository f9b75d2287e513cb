"""Language identification, words first, with backoff to ever shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by its
longest known character n-grams: the mean of those of length 5, if none is known that of length 4, and so on. The
scores of all words of a text are added up; the language with the highest sum is the prediction, and its share after
normalisation is the score.

The model is learned from a bounded sample of labelled documents (``docs_per_language``, chosen by a hash of id and
text); of that sample every label, word and n-gram is kept. Words and n-grams are 64-bit hashes of their code
points, held as sorted arrays with one entry for each language that has them, so a table of a million n-grams takes
some 25 MB whatever the number of languages. Texts are hashed and looked up by whole arrays, not word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evalkiln.llm.common import carried, filled, restored, small_batches

LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Code points that are looked up at once; longer texts are cut at white space and their sums added.
CHARS = 1 << 20
#: Multiplier of the polynomial hash and of its last step.
BASE, LAST = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
EDGES = np.array([ord("^"), ord("$")], np.uint64)
_SPACE = re.compile(r"\s")


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it part of a word (the class ``[^\\W\\d_]``), and is it a letter."""
    chars = list(map(chr, range(0x110000)))
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in chars), bool, len(chars)), np.fromiter(map(str.isalpha, chars), bool, len(chars))


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * LAST


@dataclass
class Words:
    """The words of some texts: code points one after the other, where each starts and how long it is, its hash and text."""

    codes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    owner: np.ndarray
    letters: np.ndarray  #: for each text, whether it has a letter


def words_of(texts: list[str]) -> Words:
    word, letter = _kinds()
    low = [t.lower() for t in texts]
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)))
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word[codes]
    turns = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, size = turns[::2], turns[1::2] - turns[::2]
    letters = np.zeros(len(texts), bool)
    letters[np.searchsorted(at, np.flatnonzero(letter[codes]), "right") - 1] = True
    own, first = codes[inside].astype(np.uint64), np.cumsum(size) - size
    if len(own):
        place = np.arange(len(own)) - np.repeat(first, size)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()) - 1, BASE))))
        hashed = _mixed(np.add.reduceat(own * power[place], first))
    else:
        hashed = np.empty(0, np.uint64)
    return Words(own, first, size, hashed, np.searchsorted(at, starts, "right") - 1, letters)


def grams_of(words: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word): the n-grams of the words ``which``, with ``^`` and ``$`` at the ends of a word if n > 1."""
    size = words.size[which]
    edge = int(n > 1)
    long = size + 2 * edge
    start = np.cumsum(long) - long
    flat = np.empty(int(long.sum()), np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[inner + np.repeat(start + edge, size)] = words.codes[inner + np.repeat(words.first[which], size)]
    if edge:
        flat[start], flat[start + long - 1] = EDGES[0], EDGES[1]
    many = np.maximum(long - n + 1, 0)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
    h, power = np.zeros(len(at), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            h += flat[at + k] * power
            power *= BASE
    return _mixed(h), np.repeat(np.arange(len(which)), many)


@dataclass
class Table:
    """Log frequencies: ``base`` of what a language doesn't have, and what each entry adds to it."""

    hashes: np.ndarray
    first: np.ndarray
    langs: np.ndarray
    adds: np.ndarray
    base: np.ndarray

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, place) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[place] == hashes, place

    def totals(self, place: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """For each owner the sum of the rows at its places."""
        n, wide = self.first[place + 1] - self.first[place], len(self.base)
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[place], n)
        cell = np.repeat(owner, n) * wide + self.langs[entry]
        sums = np.bincount(cell, self.adds[entry], owners * wide).reshape(owners, wide)
        return sums + np.bincount(owner, minlength=owners)[:, None] * self.base


@dataclass
class LanguageModel:
    languages: list[str]
    tables: dict[int, Table]  #: 0: words; n: n-grams of that length

    def knows(self, word: str) -> bool:
        return bool(self.tables and self.tables[0].places(words_of([word]).hash)[0].all())

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(scores, row): log scores of the distinct words by language, and the row of each word."""
        _, some, row = np.unique(words.hash, return_index=True, return_inverse=True)
        out = np.zeros((len(some), len(self.languages)))
        known, place = self.tables[0].places(words.hash[some])
        seen = np.flatnonzero(known)
        out[seen] = self.tables[0].totals(place[seen], np.arange(len(seen)), len(seen))
        left = np.flatnonzero(~known)
        for n in LENGTHS:
            if not len(left):
                break
            hashes, owner = grams_of(words, some[left], n)
            known, place = self.tables[n].places(hashes)
            many = np.bincount(owner[known], minlength=len(left))
            got = many > 0
            sums = self.tables[n].totals(place[known], owner[known], len(left))
            out[left[got]] = sums[got] / many[got, None]
            left = left[~got]
        return out, row

    def _added(self, texts: list[str], owners: list[int], total: np.ndarray, letters: np.ndarray) -> None:
        words = words_of(texts)
        own = np.array(owners)
        letters[own[words.letters]] = True
        if len(words.hash) and self.languages:
            scores, row = self.word_scores(words)
            owner = own[words.owner]
            for i in range(len(self.languages)):
                total[:, i] += np.bincount(owner, scores[row, i], len(total))

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for null, a text without a letter, or an empty model."""
        total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        lot, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text or ""):
                lot.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= CHARS:
                    self._added(lot, owners, total, letters)
                    lot, owners, size = [], [], 0
        if lot:
            self._added(lot, owners, total, letters)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)  # ties: the language that sorts first
        score = np.where(letters, share[np.arange(len(texts)), best] / share.sum(axis=1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], score.tolist()

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.predict_all([text])
        return langs[0], scores[0]


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about CHARS, cut at white space only."""
    at = 0
    while len(text) - at > CHARS and (m := _SPACE.search(text, at + CHARS)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 2000) -> LanguageModel:
    """Learn from rows with a label and a text: all labels, and all words and n-grams of the sample.

    The sample has about ``docs_per_language`` documents of each label, all of them where there are fewer; it is the
    one bound of the model. Rows without a label or text are not learned from; without any the model is empty.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}  # one row per label
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], {})
    number = {x: i for i, x in enumerate(languages)}
    chance = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, docs_per_language / counts[k]) * 1_000_000)))]), F.col(lang_col))
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("language sample")), F.lit(1_000_000)) < chance)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            for lang, texts in pdf.groupby("lang")["text"]:
                for piece in pieces("\n".join(texts)):
                    words = words_of([piece])
                    if not len(words.hash):
                        continue
                    hashes, some, c = np.unique(words.hash, return_index=True, return_counts=True)
                    for n in (0, *LENGTHS):
                        h, many = (hashes, c) if n == 0 else (lambda g, owner: (g, c[owner]))(*grams_of(words, some, n))
                        grams, row = np.unique(h, return_inverse=True)
                        if len(grams):
                            yield pd.DataFrame({"l": np.int32(number[lang]), "n": np.int32(n), "h": grams.view(np.int64), "c": np.bincount(row, many).astype(np.int64)})

    table = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "l int, n int, h bigint, c bigint")
    rows = table.groupBy("l", "n", "h").agg(F.sum("c").alias("c")).toArrow()  # as many rows as the bounded sample has n-grams
    n, lang, h, c = (rows.column(x).to_numpy() for x in ("n", "l", "h", "c"))
    tables = {}
    for length in (0, *LENGTHS):
        own = n == length
        order = np.lexsort((lang[own], h[own].view(np.uint64)))
        hashes, langs, many = h[own].view(np.uint64)[order], lang[own][order], c[own][order]
        distinct, first = np.unique(hashes, return_index=True)
        of_language = np.bincount(langs, many, len(languages))
        base = np.log(0.5 / (of_language + 0.5 * max(1, len(distinct))))
        tables[length] = Table(distinct, np.append(first, len(hashes)), langs.astype(np.int32), np.log(2.0 * many + 1).astype(np.float32), base)
    return LanguageModel(languages, tables)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with lang_pred and score.

    ``und`` and 0 if the text is null or has no letter, or nothing was learned. Whole texts are scored; repeated
    rows agree; columns of the same names are replaced. A tie goes to the language that sorts first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    df = carried(docs, text_col, keep)
    fields = ["kept", "__text"] if text_col in keep else ["kept"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            langs, scores = shared.value.predict_all(pdf["__text"].tolist())
            yield pdf[fields].assign(lang_pred=langs, score=scores)

    out = df.mapInPandas(run, df.select(*fields).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
    return restored(out, text_col, keep, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learned(docs: DataFrame, **options) -> LanguageModel:
    """The model of a table of documents: every document that isn't held out may be learned from."""
    return train(docs.where(~held_out()), **options)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learned(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Language-model scores by class-based bigrams after Brown et al.

Exchange clustering gives every word a class; the probability of a word is that of its class after the class before it,
times that of the word in its class. Texts end with a token of its own class, which is also what the first word follows.

* Every word of the training texts is counted. Words with at least one token in ``UNITS`` are units of the clustering;
  there can be no more than ``UNITS`` of them. Rarer words, and words never seen, are clustered by their endings: a hash
  of the last three bytes puts them into one of ``ENDINGS`` units, which bigrams count like any other unit.
* The bigrams of units are counted over all training texts and kept as one row for each unit, with its neighbours on
  either side (at most two for each unit). A step of the exchange looks at one slice of the units: each task computes for
  its units what every class would add to the log likelihood, given the counts between classes, and names the best. The
  driver holds the class of each unit and the counts between classes; a step that doesn't raise the likelihood is undone.
* Counts of words with at least one token in ``KNOWN`` (no more than ``KNOWN`` of them) go to all tasks. The rarer words
  of a text are joined with the table of counts; no such word can be a hot key of the training texts.

Probabilities add up to one: classes are smoothed towards their frequency, units and rare words by one half, and each
unit of endings holds one unseen word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalkiln.llm.common import small_batches, table, written

CLASSES = 64
#: A unit of its own is a word with one in so many tokens; a count that all tasks know is that of a word with one in so many.
UNITS, KNOWN = 100_000, 1_000_000
ENDINGS = 1024
#: Each sweep lets every unit change its class once; a step moves one slice of them.
SWEEPS, SLICES = 2, 6
#: Weight, in tokens, of the classes' frequencies against what follows a class.
PRIOR = 20.0
#: Words, or pairs of units, that a task holds before it gives them to the shuffle.
HELD = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: bytes change only A-Z and split only at \\x20 and \\x09-\\x0d."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    for batch in batches:
        for text in batch.column("text"):
            yield text.as_py()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])
        for text in _texts(batches):
            words = words_of(text)
            for at in range(0, len(words), HELD):
                found.update(words[at : at + HELD])
                if len(found) >= HELD:
                    yield give()
                    found.clear()
        if found:
            yield give()

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Units(dict):
    """word -> its number among the known words, or -1 - its ending."""

    def __missing__(self, word: bytes) -> int:
        return -1 - ending(word)


@dataclass
class Vocabulary:
    """Known words in the order of their counts. Units: own words, then the end of a text, then endings."""

    words: list[bytes]
    counts: np.ndarray  # of the known words
    own: int  # so many of them are units
    tokens: int
    types: int
    texts: int
    ending_tokens: np.ndarray
    ending_types: np.ndarray

    @property
    def end(self) -> int:
        return self.own

    @property
    def size(self) -> int:
        return self.own + 1 + ENDINGS

    def numbers(self) -> Units:
        return Units({w: i for i, w in enumerate(self.words)})

    def unit_of(self) -> np.ndarray:
        """Number of a known word -> unit; the endings of words that are no units, counted from behind, follow by negative numbers."""
        known = [i if i < self.own else self.own + 1 + ending(w) for i, w in enumerate(self.words)]
        return np.array([*known, *(self.own + ENDINGS - e for e in range(ENDINGS))], np.int64)

    def unit_counts(self) -> np.ndarray:
        return np.concatenate((self.counts[: self.own], [self.texts], self.ending_tokens))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """What the driver and the tasks know of the counts: words above the thresholds, and totals by ending of all the others."""
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = tokens + texts
    known = sorted(((r.n, bytes(r.word)) for r in counts.where(F.col("n") * KNOWN >= total).collect()), key=lambda x: (-x[0], x[1])) if tokens else []
    own = sum(n * UNITS >= total for n, _ in known)
    rest = counts.where(F.col("n") * UNITS < total).groupBy((F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % ENDINGS).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    n, v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in rest.collect():
        n[r.e], v[r.e] = r.n, r.v
    return Vocabulary([w for _, w in known], np.array([n for n, _ in known], np.int64), own, total, types + (texts > 0), texts, n, v)


def neighbours(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(unit, pairs): for each unit how often which unit stands behind it (``right``) or before it."""
    size, end = vocab.size, vocab.end
    sums = vocab.words, vocab.unit_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, unit = Units({w: i for i, w in enumerate(sums[0])}), sums[1]
        keys, counts, parts, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([keys, *parts]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([counts, np.ones(held, np.int64)]), len(every)).astype(np.int64)

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // size, pa.int32()), pa.array(keys % size, pa.int32()), pa.array(counts)], names=["u", "v", "n"])

        for text in _texts(batches):
            words = words_of(text)
            line = np.empty(len(words) + 2, np.int64)
            line[0] = line[-1] = end
            line[1:-1] = unit[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
            parts.append(line[:-1] * size + line[1:])
            held += len(line) - 1
            if held >= 4 * HELD:
                keys, counts = merged()
                parts, held = [], 0
                if len(keys) >= 8 * HELD:
                    yield give()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield give()

    pairs = texts.select("text").mapInArrow(run, "u int, v int, n bigint").groupBy("u", "v").agg(F.sum("n").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("u").alias("unit"), F.lit(True).alias("right"), F.col("v").alias("other")), F.struct(F.col("v").alias("unit"), F.lit(False).alias("right"), F.col("u").alias("other"))))
    both = pairs.select(sides.alias("s"), "n").select("s.unit", F.struct("s.right", "s.other", "n").alias("pair"))
    return written(both.groupBy("unit").agg(F.collect_list("pair").alias("pairs")), "bigrams", compression="zstd")


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, where each one's pairs begin, is right, other unit, count)."""
    lists = batch.column("pairs")
    flat = lists.flatten()
    starts = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
    return np.asarray(batch.column("unit")), starts, np.asarray(flat.field("right")).astype(bool), np.asarray(flat.field("other")), np.asarray(flat.field("n"))


def between_classes(bigrams: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """counts[a, b]: how often class b follows class a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            unit, starts, right, other, n = _opened(batch)
            cell = np.repeat(classes[unit].astype(np.int64) * k, np.diff(starts)) + classes[other]
            np.add.at(total, cell[right], n[right])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(k * k, np.int64)
    for r in bigrams.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(k, k)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(counts: np.ndarray) -> float:
    """The part of the log likelihood that the classes decide."""
    return float(_f(counts).sum() - _f(counts.sum(0)).sum() - _f(counts.sum(1)).sum())


def gains(left: np.ndarray, right: np.ndarray, own: int, now: int, counts: np.ndarray) -> np.ndarray:
    """What each class would add to the likelihood if it took a unit that is taken out of class ``now``.

    ``left`` and ``right``: how often each class stands before and behind the unit; ``own``: how often it follows itself.
    """
    left, right, m = left.copy(), right.copy(), counts.copy()
    left[now] -= own
    right[now] -= own
    m[now] -= right
    m[:, now] -= left
    m[now, now] -= own
    out, into = m.sum(1) + left, m.sum(0) + right  # the neighbours' own tokens stay
    diagonal = m.diagonal()
    b, f = np.flatnonzero(right), np.flatnonzero(left)
    rows = _f(m[:, b] + right[b]) - _f(m[:, b])
    columns = _f(m[f] + left[f, None]) - _f(m[f])
    found = rows.sum(1) + columns.sum(0)
    found[b] -= rows[b, np.arange(len(b))]
    found[f] -= columns[np.arange(len(f)), f]
    found += _f(diagonal + right + left + own) - _f(diagonal)
    return found - (_f(out + right.sum() + own) - _f(out)) - (_f(into + left.sum() + own) - _f(into))


def moves(bigrams: DataFrame, classes: np.ndarray, counts: np.ndarray, movable: np.ndarray) -> dict[int, int]:
    """unit -> a class that suits it better than its own, for the units in ``movable``; ties go to the smaller number."""
    k = len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, starts, right, other, n = _opened(batch)
            found = []
            for i in np.flatnonzero(movable[units]):
                at = slice(starts[i], starts[i + 1])
                u, r, o, m = int(units[i]), right[at], other[at], n[at]
                sides = [np.bincount(classes[o[s]], m[s], k).astype(np.int64) for s in (~r, r)]
                value = gains(*sides, int(m[r & (o == u)].sum()), int(classes[u]), counts)
                value[0] = -np.inf  # the class of the end
                best = int(value.argmax())
                if value[best] > value[classes[u]] + 1e-6:
                    found.append((u, best))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int32())], names=["unit", "class"])

    return {r[0]: r[1] for r in bigrams.mapInArrow(run, "unit int, class int").collect()}


def exchange(bigrams: DataFrame, unit_counts: np.ndarray, end: int, k: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts between classes). Units start in turn, by their counts; the end keeps class 0 for itself."""
    order = np.lexsort((np.arange(len(unit_counts)), -unit_counts))
    order = order[order != end]
    classes = np.zeros(len(unit_counts), np.int32)
    classes[order] = 1 + np.arange(len(order)) % (k - 1)
    slice_of = np.full(len(unit_counts), -1)
    slice_of[order] = (np.arange(len(order)) // (k - 1)) % SLICES
    counts = between_classes(bigrams, classes, k)
    for step in range(SWEEPS * SLICES):
        better = classes.copy()
        for unit, c in moves(bigrams, classes, counts, slice_of == step % SLICES).items():
            better[unit] = c
        after = between_classes(bigrams, better, k)
        if likelihood(after) > likelihood(counts):
            classes, counts = better, after
    return classes, counts


@dataclass
class BrownModel:
    vocab: Vocabulary
    classes: np.ndarray
    follows: np.ndarray  #: log10 of class b after class a
    emits: np.ndarray  #: log10 of a unit in its class
    ending_base: np.ndarray  #: log10 of what a rare word's count plus one half is divided by, for each ending
    counts: DataFrame

    def known_logs(self) -> np.ndarray:
        """log10 of count plus one half; what is rare comes from the join."""
        return np.log10(self.vocab.counts + 0.5)


def train(texts: DataFrame, k: int = CLASSES) -> BrownModel:
    """Learn from the column ``text`` of all rows; a null text is an empty one. No rows give a model without counts."""
    small_batches(texts.sparkSession)
    counts = written(word_counts(texts), "words", compression="zstd")
    vocab = vocabulary(counts, texts.count())
    classes, between = exchange(neighbours(texts, vocab), vocab.unit_counts(), vocab.end, k)
    own = np.bincount(classes, vocab.unit_counts(), k)
    many = np.bincount(classes, minlength=k)
    prior = np.where(many > 0, own + 0.5, 0.0)
    prior /= prior.sum()
    follows = (between + PRIOR * prior) / (between.sum(1, keepdims=True) + PRIOR)
    with np.errstate(divide="ignore"):  # classes without a unit
        logs = np.log10(follows)
    emits = np.log10((vocab.unit_counts() + 0.5) / (own + 0.5 * many)[classes])
    return BrownModel(vocab, classes, logs, emits, np.log10(vocab.ending_tokens + 0.5 * (vocab.ending_types + 1)), counts)


def score(docs: DataFrame, model: BrownModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all), and n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A null text is empty and has one token, its end. Long texts are scored whole; repeated rows stay rows of their own,
    whatever their ids; columns may have any name that isn't a result's; an empty table stays empty.
    """
    vocab = model.vocab
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)
    given = (vocab.words, vocab.unit_of(), model.classes, model.follows, model.emits, model.known_logs(), model.ending_base, vocab.own, vocab.texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, unit_of, classes, follows, emits, logs, ending_base, own, texts = given
        number = Units({w: i for i, w in enumerate(listed)})
        end, known = own, len(listed)
        log_end = np.log10(texts + 0.5)
        for batch in batches:
            sums, rare, many, sizes = [], [], [], []
            for text in batch.column("__text"):
                words = words_of(text.as_py())
                at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                units = np.append(unit_of[at], end)
                line = np.concatenate((classes[[end]], classes[units]))
                seen = at >= 0
                counted = logs[at[seen]].sum()
                by_ending = units[:-1] > own
                # A word that is known but no unit is emitted by its ending, with its count.
                value = follows[line[:-1], line[1:]].sum() + emits[units].sum() - ending_base[units[:-1][by_ending] - own - 1].sum()
                value += logs[at[seen & by_ending]].sum()
                missing = Counter(words[i] for i in np.flatnonzero(~seen))
                rare += missing.keys()
                many += missing.values()
                sizes.append(len(missing))
                sums.append((len(words) + 1, int(seen.sum()) + (texts > 0), counted + log_end, value))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
            lists = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(many, pa.int64())], names=["word", "m"])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            own_columns = [pa.array([s[i] for s in sums], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), batch.column("row"), *own_columns, pa.ListArray.from_arrays(offsets, lists)],
                names=["kept", "row", "n_tokens", "n_known", "base", "value", "rare"],
            )

    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("__text")).withColumn("row", F.monotonically_increasing_id())
    kept = rows.schema["kept"].dataType.simpleString()
    scored = written(rows.mapInArrow(run, f"kept {kept}, row bigint, n_tokens bigint, n_known bigint, base double, value double, rare array<struct<word: binary, m: bigint>>"), "scored", compression="zstd")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m")
    others = model.counts.where(F.col("n") * KNOWN < vocab.tokens)
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    joined = rare.join(others, "word", "left").groupBy("row").agg(F.sum(F.col("m") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    total = float(np.log10(vocab.tokens + 0.5 * (vocab.types + 1)))
    value = F.col("value") + more
    return scored.drop("rare").join(joined, "row", "left").select(
        *[F.col("kept")[c].alias(c) for c in keep], "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * total).alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """One in five ids, by a checksum; rows without an id are for training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs.where(~held_out())), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")

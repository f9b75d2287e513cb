"""Benchmark decontamination by suffix arrays of the training text.

The training text is cut into shards (one Arrow batch of documents each). A shard's suffix array holds the word
positions of its documents in lexicographic order of what follows them. Every suffix of every test item is then
binary-searched in every shard; a hit gives the range of training positions that share its first ``window`` words,
and each is extended to the longest verbatim match. Affected documents are removed by ``drop_contaminated``.

Two things keep the arrays small without losing a match. Words are numbered by the test vocabulary, all other
words are 0, and a match cannot cross a 0, so positions followed by too short a run of test words never enter the
array. And positions are sorted by their first ``window`` words only, as deeper order changes no range.

The test items are the stated query set: they are read in blocks of about BLOCK_WORDS words. A block is broadcast on
its own; if there are several, the result of each is written before the next is read, and its broadcast is released,
so driver and executors hold one block at a time. A further block is a further pass over the rows, not a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from evalkiln.llm.common import carried, filled, restored, small_batches, written

WINDOW = 10
#: Words of test items in one broadcast block.
BLOCK_WORDS = 2_000_000
#: Pairs of places that are compared at once.
CELLS = 1 << 22
#: A-Z become a-z; digits, a-z and all bytes from 0x80 on stay; the rest separates words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_pos", T.IntegerType()), T.StructField("doc_pos", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_places", T.IntegerType())])

ADDED = {"n_words": "bigint", "hit_from": "array<int>", "hit_to": "array<int>", "items": "array<string>", "matches": f"array<{MATCH.simpleString()}>"}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class TestBlock:
    """A block of test items, numbered by its own vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.ids: list[str] = []
        self.words: list[np.ndarray] = []
        windows: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            own = np.array([number.setdefault(w, len(number) + 1) for w in words_of(text)], ">u4")
            if not len(own):
                continue
            length = min(window, len(own))
            for at in range(len(own) - length + 1):
                windows[length][own[at : at + length].tobytes()].append((len(self.ids), at))
            self.ids.append(item_id)
            self.words.append(own.astype(np.int64))
        #: For each window length: the different windows in order, the items of each, and all its places: item,
        #: position, and the word before (-1 at the start of an item).
        self.windows = []
        for length, by in sorted(windows.items()):
            keys = sorted(by)
            places = [np.array([(i, at, self.words[i][at - 1] if at else -1) for i, at in by[k]], np.int64) for k in keys]
            self.windows.append((length, np.array(keys, f"S{4 * length}"), [sorted({i for i, _ in by[k]}) for k in keys], places))

    def search(self, texts: list[str | None], every: bool = True) -> list[tuple[int, list[tuple[int, int]], set[str], list[tuple[str, int, int, int, int]]]]:
        """For each text of the shard: words, hit ranges [from, to), ids of occurring items, longest matches.

        With ``every`` a window is followed to all its places in the items, else only to the first of them.
        """
        get, flat, starts = self.vocabulary.get, [0], []
        counts = []
        for text in texts:
            starts.append(len(flat))
            own = words_of(text)
            counts.append(len(own))
            flat.extend([get(w, 0) for w in own])
            flat.append(0)
        shard, begin = np.array(flat, np.int64), np.array(starts, np.int64)
        zeros = np.flatnonzero(shard == 0)
        run = np.repeat(zeros[1:], np.diff(zeros)) - np.arange(len(shard) - 1)  # positions up to the next 0, itself included if it is one
        change = np.zeros(len(shard) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        found: dict[int, list[tuple[str, int, int, int, int]]] = defaultdict(list)
        for length, keys, owners, places in self.windows:
            at = np.flatnonzero((run >= length) & (shard[:-1] > 0))
            if not len(at):
                continue
            view = np.lib.stride_tricks.sliding_window_view(shard, length)[at].astype(">u4")
            suffixes = np.ascontiguousarray(view).view(f"S{4 * length}").ravel()
            order = np.argsort(suffixes, kind="stable")
            suffixes, at = suffixes[order], at[order]
            low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            for k in np.flatnonzero(high > low).tolist():
                hit = at[low[k] : high[k]]
                np.add.at(change, hit, 1)
                np.add.at(change, hit + length, -1)
                own = np.searchsorted(begin, hit, "right") - 1
                for d in np.unique(own).tolist():
                    items[d].update(self.ids[i] for i in owners[k])
                for p, d, item, pos in self._starts(hit, own, shard, places[k] if every else places[k][:1]):
                    found[d].append((self.ids[item], pos, p - starts[d], self._length(item, pos, p, shard), len(places[k])))
        covered = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
        ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b in edges.reshape(-1, 2).tolist():  # a separator is never covered, so a range lies in one document
            d = int(np.searchsorted(begin, a, "right")) - 1
            ranges[d].append((a - starts[d], b - starts[d]))
        return [(n, ranges[d], items[d], sorted(found[d], key=lambda m: (m[2], -m[3], m[0], m[1])) if d in found else []) for d, n in enumerate(counts)]

    @staticmethod
    def _starts(hit: np.ndarray, own: np.ndarray, shard: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(position, document, item, item position) of the window's places where the words before differ: a longest match starts there."""
        for at in range(0, len(hit), max(1, CELLS // len(places))):
            some = slice(at, at + max(1, CELLS // len(places)))
            h, q = np.nonzero(shard[hit[some] - 1][:, None] != places[:, 2][None, :])
            yield from zip(hit[some][h].tolist(), own[some][h].tolist(), places[q, 0].tolist(), places[q, 1].tolist())

    def _length(self, item: int, pos: int, p: int, shard: np.ndarray) -> int:
        """How many words agree from here on; a separator agrees with none."""
        words = self.words[item][pos:]
        step, n = 64, 0
        while n < len(words):
            text = shard[p + n : p + n + min(step, len(words) - n)]  # the shard ends with a separator, so a cut text differs
            differ = np.flatnonzero(words[n : n + len(text)] != text)
            if len(differ):
                return n + int(differ[0])
            n, step = n + step, 4 * step
        return len(words)


def count_blocks(bench: DataFrame, text_col: str, block_words: int) -> int:
    return 1 + (bench.agg(F.sum(F.length(text_col))).first()[0] or 0) // (6 * block_words)


def test_blocks(bench: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestBlock]:
    """Read the test items block by block, at least one; a block is a hash class of items."""
    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t"))
    blocks = count_blocks(bench, text_col, block_words)
    for b in range(blocks):
        block = TestBlock([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()], window)
        if block.ids or b == 0:
            yield block


test_blocks.__test__ = False


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None, every_place: bool = True) -> DataFrame:
    """The columns ``keep`` (default: all) of every row of ``docs`` and what the search found in its text.

    Adds n_words, hit_from and hit_to (word ranges in a window that a test item shares), items (ids of the items
    with such a window, as strings) and matches (every longest verbatim match of a window or more with its places in
    item and text, by place in the text, then length, and with the number of places that its first window has in the
    items). A window that very many items share, such as a line of a template, has as many places in each document that
    holds it; without ``every_place`` a match is told for the first of them only, and ``n_places`` counts the others, so a
    row's matches are at most as many as its words. Hits and items are the same either way. Rows stay as they are: null and empty texts have no words,
    repeated rows are each searched, an empty benchmark hits nothing. Added columns replace columns of the
    same names; a repeated or null item id counts as one item (``null``).
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = ADDED
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    fields = ["kept", "__text", *new]
    df = carried(docs, text_col, keep).withColumns({c: (F.lit(0) if c == "n_words" else F.array()).cast(kind) for c, kind in new.items()})
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in fields])
    several = count_blocks(bench, bench_text_col, block_words) > 1
    for block in test_blocks(bench, item_col, bench_text_col, window, block_words):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in filled(batches):
                got = shared.value.search(pdf["__text"].tolist(), every_place)
                pdf["n_words"] = [n for n, _, _, _ in got]
                pdf["hit_from"] = [[*old, *(a for a, _ in r)] for old, (_, r, _, _) in zip(pdf["hit_from"], got)]
                pdf["hit_to"] = [[*old, *(b for _, b in r)] for old, (_, r, _, _) in zip(pdf["hit_to"], got)]
                pdf["items"] = [sorted({*old, *i}) for old, (_, _, i, _) in zip(pdf["items"], got)]
                pdf["matches"] = [[*old, *(dict(zip(MATCH.names, x)) for x in m)] for old, (_, _, _, m) in zip(pdf["matches"], got)]
                yield pdf[fields]

        df = df.mapInPandas(search, schema)
        if several:
            df = written(df, "test-block")
            shared.unpersist()
    return restored(df, text_col, keep, *new)


def n_hit(hit_from: str = "hit_from", hit_to: str = "hit_to"):
    """Words in the union of the hit ranges; ranges of several blocks may overlap."""
    pairs = F.array_sort(F.arrays_zip(F.col(hit_from).alias("a"), F.col(hit_to).alias("b")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(pairs, zero, step, lambda s: s["n"]).cast("bigint")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that share a window with a test item; columns and other rows are unchanged.

    Null and empty texts share nothing and stay; repeated rows go or stay together; an empty benchmark drops nothing;
    columns may have any name.
    """
    columns = docs.columns
    found = scan(docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("text")), bench, text_col="text", **{"every_place": False} | options)
    return found.where(F.size("hit_from") == 0).select("row.*")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = scan(docs.select("doc_id", "text"), bench, keep=["doc_id"], every_place=False)
    hit = n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

"""Byte-level BPE: distinct words are folded by ranked merges, decoding concatenates the binary pieces.

The fold is written with Spark's higher-order functions over the bytes of a word and a rank map
(``fold_words``). It runs over the distinct frequent words of the corpus, and its result, at most ``dictionary_words``
rows, is broadcast. Encoding then is one pass over the texts without a shuffle, some thousand at a time: their distinct
words in the dictionary take the folded ids, the others are folded together in the task by the same rule
(``Ranks.fold_all``). Folding every distinct word with higher-order functions and joining the ids back to the texts was
measured and given up: see the README.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalkiln.llm.common import carried, release, restored, small_batches, written
from evalkiln.llm.spans import let

#: Words a task proposes for the dictionary and words the dictionary has.
PROPOSED = 20_000
DICTIONARY = 50_000
#: Words that a task counts before it lets rare ones go.
CACHE = 300_000
#: Bytes of text that a task counts, and encodes, at once.
COUNTED, ENCODED = 4 << 20, 2 << 20
#: No such merge.
NONE = 2**31 - 1
#: Longer words are merged with a heap.
SHORT = 64


class Ranks:
    """The vocabulary of a rank file and the fold of one word."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        top = max(self.rank.values()) + 1
        self.pieces: list[bytes] = [b""] * top
        for piece, r in self.rank.items():
            self.pieces[r] = piece

    def fold(self, word: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        get = self.rank.get
        if (whole := get(word)) is not None:
            return [whole]
        if len(word) > SHORT:
            return self._fold_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            new = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + new, NONE)
            if i < len(ranks):
                ranks[i] = get(new + parts[i + 1], NONE)
        return [self.rank[p] for p in parts]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the single bytes; keys of all pairs of pieces that merge, in order; the ranks of these."""
        top, found = len(self.pieces), {}
        for piece, r in self.rank.items():
            for i in range(1, len(piece)):
                a, b = self.rank.get(piece[:i]), self.rank.get(piece[i:])
                if a is not None and b is not None:
                    found[a * top + b] = r
        keys = np.array(sorted(found), np.int64)
        return np.array([self.rank.get(bytes([b]), NONE) for b in range(256)], np.int64), keys, np.array([found[k] for k in keys.tolist()] + [NONE], np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, keys, ranks = self.pairs
        wanted = a * len(self.pieces) + b
        at = np.searchsorted(keys, wanted)
        return np.where(np.append(keys, -1)[at] == wanted, ranks[at], NONE)

    def fold_all(self, words: list[bytes]) -> list[bytes]:
        """``fold`` of many words at once, as bytes (little endian, 32 bits): a round merges one pair in each word."""
        out: list[bytes] = [b""] * len(words)
        some = []
        for i, w in enumerate(words):
            if (whole := self.rank.get(w)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > SHORT:
                out[i] = np.array(self._fold_long(w), "<i4").tobytes()
            elif w:
                some.append(i)
        if not some:
            return out
        token = self.pairs[0][np.frombuffer(b"".join([words[i] for i in some]), np.uint8)]
        word = np.repeat(np.arange(len(some)), [len(words[i]) for i in some])
        rank = np.full(len(token), NONE, np.int64)  # of a token with the next one of its word
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks(token[inner], token[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            least = np.minimum.reduceat(rank, starts)
            going = least < NONE
            if not going.all():
                stay = np.repeat(going, sizes)
                done.append((word[~stay], token[~stay]))
                token, word, rank, sizes, least = token[stay], word[stay], rank[stay], sizes[going], least[going]
            if not len(token):
                break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.diff(word[at], prepend=-1) > 0]  # the leftmost of equals
            token[at] = least
            rank[at] = NONE
            right = at[(at + 2 < len(word)) & (word[np.minimum(at + 2, len(word) - 1)] == word[at])]
            rank[right] = self._ranks(token[right], token[right + 2])
            left = at[(at > 0) & (word[at - 1] == word[at])]
            rank[left - 1] = self._ranks(token[left - 1], token[left])
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, word, rank = token[keep], word[keep], rank[keep]
        word, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        data, stops = token[order].astype("<i4").tobytes(), np.cumsum(np.bincount(word, minlength=len(some))) * 4
        for i, a, b in zip(some, [0, *stops.tolist()], stops.tolist()):
            out[i] = data[a:b]
        return out

    def _fold_long(self, word: bytes) -> list[int]:
        n, get = len(word), self.rank.get
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:  # merged since it was put on the heap
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [self.rank[p] for p in parts if p is not None]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


#: An array of small maps from the hexadecimal piece to its rank, by the hash of the piece.
RANK_MAP = T.ArrayType(T.MapType(T.StringType(), T.IntegerType()))


def rank_json(ranks: Ranks, buckets: int = 1 << 15) -> str:
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, r in ranks.rank.items():
        key = piece.hex().upper()
        table[xxhash.xxh64_intdigest(key.encode(), 42) % buckets][key] = r
    return json.dumps(table)


def fold_words(word: Column, ranks: Ranks, buckets: int = 1 << 15) -> Column:
    """The token ids of a word (binary), by folding ranked merges over its bytes with higher-order functions."""
    return let(F.from_json(F.lit(rank_json(ranks, buckets)), RANK_MAP), lambda table: _folded(word, table, buckets))


def _folded(word: Column, table: Column, buckets: int) -> Column:
    # a power of two, so the bits of the signed hash give the bucket of the unsigned one
    rank = lambda piece: F.coalesce(F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(buckets - 1)).cast("int"))[piece], F.lit(NONE))
    parts = F.regexp_extract_all(F.hex(word), F.lit(".."), F.lit(0))
    none, no_rank = F.array().cast("array<string>"), F.array().cast("array<int>")

    def start(p: Column) -> Column:
        ranks_now = F.when(F.size(p) < 2, no_rank).otherwise(F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: rank(F.concat(F.get(p, i), x))))
        return F.struct(p.alias("p"), ranks_now.alias("r"))

    def merged(s: Column, i: Column) -> Column:
        p, r = s["p"], s["r"]
        new = F.concat(F.get(p, i - 1), F.get(p, i))
        left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(no_rank)
        right = F.when(i < F.size(r), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(no_rank)
        return F.struct(
            F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r))).alias("r"),
        )

    def step(s: Column, _: Column) -> Column:
        least = F.coalesce(F.array_min(s["r"]), F.lit(NONE))
        place = F.array_position(s["r"], least).cast("int")
        return F.when(least == NONE, s).otherwise(merged(s, place))

    folded = let(parts, lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), start(p), step, lambda s: F.transform(s["p"], rank)))
    whole = rank(F.hex(word))
    return F.when(F.length(word) == 0, no_rank).when(whole != NONE, F.array(whole)).otherwise(folded)


def gathered(batches: Iterator[pa.RecordBatch], size: int = ENCODED) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes, or of one of the batches that come; none is empty."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if held and (batch is None or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        if batch is not None and batch.num_rows:
            held.append(batch)


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", proposed: int = PROPOSED, at_most: int = DICTIONARY) -> DataFrame:
    """(word, n): the words that are most frequent over all texts; each task proposes its own most frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found, held = regex.compile(pattern).findall, Counter(), []

        def counted() -> None:
            chunks = pa.concat_arrays(held).value_counts()
            words = [find(f" {chunk}") for chunk in chunks.field("values").to_pylist()]
            n = np.repeat(chunks.field("counts").to_numpy(), np.fromiter(map(len, words), np.int64, len(words)))
            each = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
            found.update(dict(zip(each.dictionary.to_pylist(), np.bincount(each.indices.to_numpy(), n, len(each.dictionary)).astype(np.int64).tolist())))
            held.clear()

        for batch in batches:
            held.append(pc.split_pattern(batch.column("text").drop_null(), " ").flatten())
            if sum(x.nbytes for x in held) > COUNTED:
                counted()
                if len(found) > 2 * CACHE:
                    found = Counter(dict(found.most_common(CACHE)))
        if held:
            counted()
        best = found.most_common(proposed)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(at_most)


def _bounds(lengths: pa.Array | np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _grouped(lists: pa.ListArray, sizes: np.ndarray) -> pa.ListArray:
    """Runs of so many lists each, joined."""
    stops = _bounds(pc.list_value_length(lists).to_numpy())
    return pa.ListArray.from_arrays(pa.array(stops[_bounds(sizes)], pa.int32()), lists.flatten())


class Encoder:
    """The ids of many texts at once: each distinct chunk is cut once and each distinct word is folded once."""

    def __init__(self, ranks_path: str, pattern: str, known: dict[str, bytes]):
        self.ranks, self.find, self.known = ranks_of(ranks_path), regex.compile(pattern).findall, known

    def of_words(self, words: list[str]) -> pa.ListArray:
        found = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.ranks.fold_all([words[i].encode() for i in new])):
            found[i] = ids
        data = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
        return pa.ListArray.from_arrays(pa.array(_bounds([len(x) // 4 for x in found]), pa.int32()), data)

    def of_texts(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, none for null.

        A text is cut before each space where no space is next to other white space: such a space always starts a word
        of the pattern, so chunks can be cut into words apart from each other. A text with any other space stays whole.
        """
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        chunks = parts.flatten().dictionary_encode()
        at, distinct = chunks.indices.to_numpy(), chunks.dictionary
        starts = _bounds(pc.list_value_length(parts).to_numpy())[:-1]
        heads = pc.utf8_slice_codeunits(distinct, 0, 1).dictionary_encode()
        gap = np.array([not c or c.isspace() for c in heads.dictionary.to_pylist()], bool)[heads.indices.to_numpy()]
        whole = np.logical_or.reduceat(gap[at], starts)
        later = ~np.repeat(whole, np.diff(starts, append=len(at)))
        later[starts] = False
        used = np.flatnonzero(np.bincount(at[later], minlength=len(distinct)))

        # What follows a space is cut as one text, in which a space starts each chunk; what starts a text is cut by itself.
        first = pc.if_else(pa.array(whole), texts, distinct.take(pa.array(at[starts])))
        cut = [self.find(x) for x in first.to_pylist()]
        rest = self.find(" " + " ".join(distinct.take(pa.array(used)).to_pylist())) if len(used) else []
        sizes = np.concatenate((np.array(list(map(len, cut)), np.int64), np.diff(np.flatnonzero(pc.starts_with(pa.array(rest, pa.string()), " ")), append=len(rest))))
        words = pa.array(chain(chain.from_iterable(cut), rest), pa.string()).dictionary_encode()
        of_chunk = _grouped(self.of_words(words.dictionary.to_pylist()).take(words.indices), sizes)

        place = np.zeros(len(distinct), np.int64)
        place[used] = len(cut) + np.arange(len(used))
        order = place[at]
        order[starts] = np.arange(len(cut))
        later[starts] = True
        return _grouped(of_chunk.take(pa.array(order[later])), np.add.reduceat(later, starts, dtype=np.int64))


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The bytes that the ids stand for: the binary pieces, concatenated. No list is null."""
    taken = pieces.take(ids.flatten())
    stops = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    bounds = _bounds(pc.list_value_length(ids).to_numpy())
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stops[bounds].astype(np.int32)), taken.buffers()[2] or pa.py_buffer(b"")])


def folded_words(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", at_most: int = DICTIONARY) -> dict[str, bytes]:
    """The ids (little endian, 32 bits) of the frequent words, at most ``at_most``: one job, whose rows come as Arrow columns.

    The driver keeps neither the vocabulary nor a row object for each word. The rank map is the one row of a broadcast
    table: as a literal of the fold it would be written out in each text of the plan that Spark makes and keeps.
    """
    # The word length bound keeps the higher-order fold short; longer words are folded in the tasks.
    words = frequent_words(docs, pattern, text_col, at_most=at_most).where(F.octet_length("word") <= SHORT).select("word")
    spark, buckets = docs.sparkSession, 1 << 15
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = written(spark.createDataFrame([(rank_json(Ranks(ranks_path), buckets),)], "ranks string").select(F.from_json("ranks", RANK_MAP).alias("ranks")), "bpe-ranks")
    # Some hundred words meet the rank map at once: a joined row holds a copy of it.
    groups = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(parts, at_most // 250))).alias("g")).agg(F.collect_list("word").alias("words"))
    fold = lambda w: F.struct(w.alias("word"), _folded(w.cast("binary"), F.col("ranks"), buckets).alias("ids"))
    folded = groups.crossJoin(F.broadcast(table)).select(F.inline(F.transform("words", fold))).toArrow()
    release(table)
    known: dict[str, bytes] = {}
    for batch in folded.to_batches():
        lists = batch.column("ids")
        ids, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        known.update((w, ids[4 * a : 4 * b]) for w, a, b in zip(batch.column("word").to_pylist(), at[:-1].tolist(), at[1:].tolist()))
    return known


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, dictionary_words: int = DICTIONARY, bytes_col: str | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row with its token ids (array<int>).

    With ``bytes_col`` the ids are decoded again in the same pass, as ``decode`` does, and the bytes are a column too.

    Ids are those of the merges by rank within each match of ``pattern``; there are no special tokens. Null and
    empty texts have no ids. Texts and words are encoded whole, whatever their length. ``ranks_path`` is a file that
    the driver and every executor can read. A column named ``ids_col`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, bytes_col)]
    dictionary = spark.sparkContext.broadcast(folded_words(docs, ranks_path, pattern, text_col, dictionary_words))

    df = carried(docs, text_col, keep)
    fields = ["kept", "__text"] if text_col in keep else ["kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern, dictionary.value)
        pieces = pa.array(encoder.ranks.pieces, pa.large_binary())
        for batch in gathered(batches):
            ids = encoder.of_texts(batch.column("__text"))
            columns = [*(batch.column(c) for c in fields), ids]
            if bytes_col:
                columns.append(joined_pieces(ids, pieces))
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, *new])

    new = ["__ids", "__bytes"] if bytes_col else ["__ids"]
    kinds = {"__ids": T.ArrayType(T.IntegerType()), "__bytes": T.BinaryType()}
    out = df.mapInArrow(run, T.StructType([*df.select(*fields).schema, *(T.StructField(c, kinds[c]) for c in new)]))
    return restored(out, text_col, keep, *new).withColumnsRenamed({"__ids": ids_col, "__bytes": bytes_col or "__bytes"})


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids stand for: the binary pieces, concatenated. Null ids give null."""
    small_batches(encoded.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = ranks_of(ranks_path).pieces.__getitem__
        for ids in batches:
            yield pd.Series([None if x is None else b"".join(map(piece, x.tolist())) for x in ids])

    return encoded.withColumn(bytes_col, pieces(F.col(ids_col)))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents, encoded and decoded again."""
    found = encode(docs, ranks_path, pattern, keep=["doc_id"], bytes_col="decoded")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

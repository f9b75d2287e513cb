"""Near-duplicate documents by SimHash fingerprints and an anchor-point covering.

Fingerprints within a threshold of each other are found with a covering code. Its codewords are the anchors.
Every fingerprint lives at its nearest anchor and is replicated to every anchor within the covering radius plus
the threshold; if two fingerprints differ in few enough bits, one of them is replicated to where the other
lives, so comparing residents with replicas anchor by anchor loses no pair.

The code is a product of perfect codes on separate bits: twice the binary Golay code of length 23 (radius 3,
4,096 words), so 2**24 anchors. A difference of ``t`` bits splits over the two blocks, and the ball "radius plus
threshold" is taken as all words with block distances of at most 3 + e1 and 3 + e2, e1 + e2 <= t. That is about
60 replicas for t = 2, whatever the fingerprint. A Hamming block of the remaining bits makes the anchors finer
(``CODE_FINE``) for 2.5 times the replicas; ``code_for`` takes the cheaper one. The pairs are the same with either code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from evalkiln.llm.common import filled, join_groups, small_batches, written
from evalkiln.llm.components import connected_components

#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: Blocks of a code: (kind, first bit, length, covering radius).
CODE = (("golay", 0, 23, 3), ("golay", 23, 23, 3))
CODE_FINE = (*CODE, ("hamming", 46, 15, 1))
#: What it costs to make, shuffle and sort a replica, in comparisons of two fingerprints of an anchor (an estimate).
REPLICA_COST = 4
#: Fingerprints whose replicas are made at once.
BATCH = 2000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text, 0 if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0d split
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory of very long texts
        part = [hashed(joined[i:j], seed) for i, j in zip(starts[at : min(n, at + (1 << 16))].tolist(), stops[at + k - 1 : min(n, at + (1 << 16)) + k - 1].tolist())]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64 bits as a signed long. Null and word-free texts have 0; every row is kept."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            fp = np.fromiter((fingerprint(x, shingle) for x in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp bigint")


@lru_cache
def _ball(kind: str, length: int, radius: int, extra: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of single bits; for each e <= extra the error patterns of excess weight e by syndrome: patterns, first places, counts."""
    if kind == "golay":
        column, x = [], 1
        for _ in range(length):
            column.append(x)
            x <<= 1
            if x >> 11:
                x ^= GOLAY
    else:
        column = list(range(1, length + 1))
    size = max(1 << c.bit_length() for c in column)
    found: list[list[tuple[int, int]]] = [[] for _ in range(extra + 1)]
    for weight in range(radius + extra + 1):
        for bits in combinations(range(length), weight):
            s = v = 0
            for b in bits:
                s ^= column[b]
                v |= 1 << b
            found[max(0, weight - radius)].append((s, v))
    tables = []
    for patterns in found:
        syndrome, pattern = np.array(sorted(patterns), np.int64).reshape(-1, 2).T
        counts = np.bincount(syndrome, minlength=size)
        tables.append((pattern, np.cumsum(counts) - counts, counts))
    return np.array(column, np.int64), tables


def _blocks(fps: np.ndarray, threshold: int, code: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, list, int]]:
    """For each block of the code: the words of all fingerprints, their syndromes, the patterns, and the first bit in an anchor."""
    shift, prints = 0, fps.view(np.uint64)
    for kind, first, length, radius in code:
        column, tables = _ball(kind, length, radius, threshold)
        words = ((prints >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)
        syndromes = np.zeros(len(words), np.int64)
        for b in range(length):
            syndromes ^= np.where(words >> b & 1, column[b], 0)
        yield words, syndromes, tables, shift
        shift += length


def homes(fps: np.ndarray, code: tuple = CODE) -> np.ndarray:
    """The anchor where each fingerprint (signed longs) lives."""
    out = np.zeros(len(fps), np.int64)
    for words, syndromes, tables, shift in _blocks(fps, 0, code):
        pattern, first, _ = tables[0]
        out |= (words ^ pattern[first[syndromes]]) << shift
    return out


def replicas(fps: np.ndarray, threshold: int = 2, code: tuple = CODE) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, places): every anchor that a fingerprint is replicated to, and the fingerprint's place in ``fps``."""
    blocks, anchors, places = list(_blocks(fps, threshold, code)), [], []
    for excess in product(range(threshold + 1), repeat=len(code)):
        if sum(excess) > threshold:
            continue
        at, anchor = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for (words, syndromes, tables, shift), e in zip(blocks, excess):
            pattern, first, counts = tables[e]
            n, s = counts[syndromes[at]], syndromes[at]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            anchor = np.repeat(anchor, n) | (np.repeat(words[at], n) ^ pattern[np.repeat(first[s], n) + nth]) << shift
            at = np.repeat(at, n)
        anchors.append(anchor)
        places.append(at)
    return np.concatenate(anchors), np.concatenate(places)


@lru_cache
def replicas_each(threshold: int, code: tuple) -> float:
    """The mean number of replicas of a fingerprint."""
    some = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, BATCH)
    return len(replicas(some, threshold, code)[0]) / len(some)


def code_for(n: int, threshold: int = 2) -> tuple:
    """The code with the least work for ``n`` distinct fingerprints: replicas, and comparisons with the residents of their anchors."""

    def cost(code: tuple) -> float:
        # A perfect code of length 23 has 2**12 words, a Hamming code of length 15 has 2**11.
        anchors = 2 ** sum(12 if kind == "golay" else 11 for kind, *_ in code)
        return replicas_each(threshold, code) * (REPLICA_COST + n / anchors)

    return min((CODE, CODE_FINE), key=cost)


def near_pairs(fps: DataFrame, threshold: int = 2, code: tuple | None = None) -> DataFrame:
    """Pairs (src, dst) of different fingerprints in ``fps.fp`` that differ in <= threshold bits, each once.

    ``fps.fp`` has distinct longs, none of them null; other columns are not read; an empty table has no pairs. Unless a
    code is given, the rows are counted for ``code_for``.
    """
    code = code or code_for(fps.count(), threshold)

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            for at in range(0, len(pdf), BATCH):
                own = pdf["fp"].to_numpy()[at : at + BATCH]
                anchors, places = replicas(own, threshold, code)
                yield pd.DataFrame({"anchor": anchors, "other": own[places]})

    def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            yield pd.DataFrame({"anchor": homes(pdf["fp"].to_numpy(), code), "fp": pdf["fp"]})

    residents = fps.select("fp").mapInPandas(live, "anchor bigint, fp bigint")
    others = fps.select("fp").mapInPandas(replicate, "anchor bigint, other bigint")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    # sorted, not broadcast: Spark takes the replicas to be as small as the fingerprints that they are made from
    return residents.join(others.hint("merge"), "anchor").where((F.col("fp") != F.col("other")) & (apart <= threshold)).select(F.least("fp", "other").alias("src"), F.greatest("fp", "other").alias("dst")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, code: tuple | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Copies share a fingerprint and are reduced to it before any pair is looked at, so a group of equal texts
    costs one row, and a fingerprint of very many rows is joined apart from the others. What grows with the documents is joined by sorting. The code is chosen by the
    number of fingerprints unless it is given. component_id is the smallest id reachable over links. Rows whose id is null keep their
    fingerprint and get the component of their fingerprint; other columns of ``docs`` are not read; an empty
    table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")), "simhash-distinct")
    code = code or code_for(distinct.count(), threshold)  # of the written table: its row counts are in the files
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    label = connected_components(near_pairs(distinct.repartition(parts, "fp"), threshold, code))
    label = distinct.join(label.hint("merge"), distinct.fp == label.node, "left").select("fp", "n", "least_id", F.coalesce("component", "fp").alias("component"))
    least = label.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_print = written(label.join(least.hint("merge"), "component").select("fp", "n", "component_id"), "simhash-groups")
    return join_groups(prints, by_print, "fp", "n", sort=True).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

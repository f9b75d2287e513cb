"""The near-duplicate stage: SimHash groups of five-word shingles, completed to all pairs of a Jaccard coefficient >= 0.8.

SimHash alone doesn't reach this threshold: two texts with a coefficient of 0.8 are expected to differ in 9.7 of 64
bits (standard deviation 2.9), and a covering of such a radius has very many replicas. So the pairs of operator 8
(``simhash.near_pairs``: fingerprints that differ in few bits, by the anchor-point covering) are the first candidates;
the others come from prefixes. With the shingles of every set in one common order, two sets of coefficient >= t share
one of the first n - ceil(t n) + 1 shingles of each. Candidates are bounded by sizes, places and the shingles that no
other set has, then by parities of the whole sets (``parity``), and the coefficient of every candidate of either kind is computed on the whole sets, so the result is exact.

Any order gives the same result; rare shingles come first, so that wording shared by very many texts makes no
candidates. Rarity is read from counts in a table of fixed size.

Every table here grows with the documents, so all joins are by sorting. Spark would size many sides by the packed bytes
of their files, or as what they are made from, and send them through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalkiln.llm.common import bucketed, filled, join_groups, release, small_batches, written, tidy
from evalkiln.llm.components import connected_components
from evalkiln.llm.simhash import code_for, near_pairs

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
#: Counters of the table that tells frequent shingles from rare ones.
BUCKETS = 1 << 16
#: Odd multiplier of the hash of a shingle from those of its words.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Rows in one frame that goes back to Spark.
ROWS = 1 << 16


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; texts of fewer words are one shingle, word-free ones none."""
    words = (text or "").encode().lower().split()  # as in simhash: only A-Z change, only \\x20 and \\x09-\\x0d split
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    hashed = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w, 42)) for w in words], np.uint64)
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * STEP + hashed[i : len(hashed) - k + 1 + i]
    out ^= out >> np.uint64(31)
    return np.unique(out * STEP)


def set_id(shingles: np.ndarray) -> int:
    """A signed long that stands for the set; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).astype(np.int64)) if len(shingles) else 0


def shingle_print(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed long: a bit is 1 if it is set in over half of the (remixed) hashes."""
    h = (shingles ^ (shingles >> np.uint64(29))) * STEP
    h ^= h >> np.uint64(32)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h)).view(">i8")[0]) if len(h) else 0


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of some bits, packed in longs: a power of two, 4 at least, with a bit a shingle.

    A shingle in one of two sets changes one bit, one in both changes none, so the bits that differ are no more than the
    shingles that stand in one set only. The halves of a longer parity, added bit by bit, are the shorter one.
    """
    bits = np.uint64(max(256, 1 << max(0, len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & (bits - np.uint64(1))).astype(np.int64), minlength=int(bits)) & 1, bitorder="little").view("<i8")


def differing_bits(a: Column, b: Column) -> Column:
    """Differing bits of two parities; 0, which says nothing, if one is over twice as long as the other."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def folded(p: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(p) == 2 * half, F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), xor)).otherwise(p)

    a, b = folded(a, b), folded(b, a)
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, xor), F.lit(0), lambda n, x: n + F.bit_count(x))).otherwise(0)


def jaccard_reaches(a: np.ndarray, b: np.ndarray, least: Fraction = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def similar_links(sets: DataFrame, shingle: int = SHINGLE, least: Fraction = SIMILARITY) -> DataFrame:
    """Links (src, dst) between set ids of ``sets`` (sid, fp, size, parity, text; sid distinct) whose coefficient is at least ``least``.

    All pairs are linked or connected by other links, so a group of near copies costs about one link a set and
    shingle, not the square of its size.
    """
    spark = sets.sparkSession
    num, den = least.numerator, least.denominator
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for pdf in filled(batches):
            for text in pdf["text"]:
                np.add.at(counts, (shingle_set(text, shingle) >> shift).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": some, "c": counts[some]})

    frequent = np.zeros(BUCKETS, np.int64)
    for r in sets.select("text").mapInPandas(tally, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).collect():  # at most BUCKETS rows
        frequent[r["bucket"]] = r["c"]
    shared = spark.sparkContext.broadcast(frequent)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows = [], 0
        for pdf in filled(batches):
            for sid, text in zip(pdf["sid"], pdf["text"]):
                s = shingle_set(text, shingle)
                n = len(s)
                first = s[np.argsort(shared.value[(s >> shift).astype(np.int64)], kind="stable")[: n - -(-num * n // den) + 1]]  # ties: by hash
                parts.append((first.view(np.int64), np.full(len(first), sid), np.full(len(first), n, np.int32), np.arange(1, len(first) + 1, dtype=np.int32)))
                rows += len(first)
                if rows >= ROWS:
                    yield pd.DataFrame(dict(zip(("token", "sid", "n", "at"), map(np.concatenate, zip(*parts)))))
                    parts, rows = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("token", "sid", "n", "at"), map(np.concatenate, zip(*parts)))))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            ok = [jaccard_reaches(shingle_set(x, shingle), shingle_set(y, shingle), least) for x, y in zip(pdf["one"], pdf["two"])]
            yield pdf.loc[ok, ["src", "dst"]]

    def likely(candidates: DataFrame) -> DataFrame:
        """Candidates that sizes and parities leave: a coefficient that is reached bounds the shingles in one set only.

        Without this the texts of all sets that share one shingle by chance are moved; these grow faster than the sets.
        """
        own = sets.select("sid", F.struct(F.col("size").cast("bigint").alias("size"), "parity").alias("own"))
        both = candidates.join(own.toDF("src", "a").hint("merge"), "src").join(own.toDF("dst", "b").hint("merge"), "dst")
        total = F.col("a.size") + F.col("b.size")
        both = both.where(F.least("a.size", "b.size") * den >= F.greatest("a.size", "b.size") * num)
        return both.where((total - differing_bits(F.col("a.parity"), F.col("b.parity"))) * (num + den) >= 2 * num * total).select("src", "dst")

    def verified(candidates: DataFrame) -> DataFrame:
        texts = sets.select("sid", "text")
        both = candidates.select("src", "dst").join(texts.toDF("src", "one").hint("merge"), "src").join(texts.toDF("dst", "two").hint("merge"), "dst")
        return written(both.select("src", "dst", "one", "two").mapInPandas(check, "src bigint, dst bigint"), "similar-links")

    # An overlap o reaches the threshold only if o (num + den) >= num (n + m). Of the shingles up to a shared one, two
    # sets have no more in common than either has met there: one met by no other prefix stands in no other set that has
    # the shared one in its prefix, since it would come before it.
    enough = lambda o: o * (num + den) >= num * (F.col("n").cast("bigint") + F.col("m"))
    rest = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("by"))
    possible = enough(F.least("q", "p") + rest)

    # A shingle that stands in one prefix only is dropped where the sets of a shingle meet; q counts the others of a set.
    rows = sets.select("sid", "text").mapInPandas(prefixes, "token bigint, sid bigint, n int, at int")
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1").drop("c")
    rows = rows.withColumn("q", F.row_number().over(Window.partitionBy("sid").orderBy("at")))
    rows = met = written(rows, "similar-met", compression="zstd")
    tidy(spark)  # the shuffles by shingle and by set are done with

    # SimHash: sets of one fingerprint meet the first of them, and the first ones of near fingerprints meet.
    heads = written(sets.groupBy("fp").agg(F.min("sid").alias("head")), "similar-prints")
    near = near_pairs(heads.select("fp").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "fp"), code=code_for(heads.count()))
    near = near.join(heads.toDF("src", "one").hint("merge"), "src").join(heads.toDF("dst", "two").hint("merge"), "dst").select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst"))
    same = sets.select("sid", "fp").join(heads.hint("merge"), "fp").where("sid <> head").select(F.least("sid", "head").alias("src"), F.greatest("sid", "head").alias("dst"))

    # Neighbours: each set meets a few of those with the same shingle, those next to it by size and by id.
    own = F.struct("sid", "n", "at", "q")
    orders = (Window.partitionBy("token").orderBy("n", "sid"), Window.partitionBy("token").orderBy("sid"))
    chain = rows.withColumn("near", F.array(*[F.lag(own, back).over(order) for order in orders for back in (1, 2)]))
    chain = chain.select("sid", "n", "at", "q", F.explode("near").alias("y"))
    # Hubs: each set meets that set of the same shingle which has the fewest shingles of its own. The copies of one text
    # differ from each other twice as much as from what they have in common, so most are linked over it.
    alone = F.struct((F.col("at") - F.col("q")).alias("alone"), "sid", "n", "at", "q")
    hubs = rows.groupBy("token").agg(F.min(alone).alias("y"))
    hubs = rows.join(hubs.hint("merge"), "token").select("sid", "n", "at", "q", F.struct("y.sid", "y.n", "y.at", "y.q").alias("y")).where("sid <> y.sid")
    chain = chain.union(hubs).select(F.col("sid").alias("src"), "n", "at", "q", F.col("y.sid").alias("dst"), F.col("y.n").alias("m"), F.col("y.at").alias("by"), F.col("y.q").alias("p"))
    chain = chain.where(F.col("dst").isNotNull() & possible).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    first = written(likely(chain.union(near).union(same).distinct()), "similar-first")
    tidy(spark)
    links = verified(first)
    release(first, heads)

    # Then every pair that these links leave apart; shingles that stay within one part need no pairs at all.
    part = connected_components(links)
    rows = rows.join(part.hint("merge"), rows.sid == part.node, "left").select("token", "sid", "n", "at", "q", F.coalesce("component", "sid").alias("part"))
    across = rows.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    rows = apart = written(rows.join(across.hint("merge"), "token"), "similar-across", compression="zstd")
    tidy(spark)
    a, b = rows.toDF("token", "src", "n", "at", "q", "part"), rows.toDF("token", "dst", "m", "by", "p", "other")
    meet = a.join(b.hint("merge"), "token").where((F.col("src") < F.col("dst")) & (F.col("part") != F.col("other")) & possible)
    last = meet.groupBy("src", "dst").agg(F.count("*").alias("shared"), F.max(F.struct("at", "by", "n", "m")).alias("x")).select("src", "dst", "shared", "x.*")
    second = written(likely(last.where(enough(F.col("shared") + rest)).select("src", "dst")), "similar-second")
    release(met, apart)
    out = links.union(verified(second))
    release(second)
    return out


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(row, id, uid, sid, fp, size, parity): every row whole, its number, and set id, SimHash, size and parity of its text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            found = [shingle_set(x, shingle) for x in pdf["text"]]
            yield pdf.drop(columns="text").assign(
                sid=np.array([set_id(s) for s in found], np.int64), fp=np.array([shingle_print(s) for s in found], np.int64),
                size=np.array([len(s) for s in found], np.int32), parity=[parity(s) for s in found],
            )

    kinds = {"sid": "bigint", "fp": "bigint", "size": "int", "parity": "array<bigint>"}
    return own.mapInPandas(mark, own.drop("text").withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()}).schema)


def _labelled(marked: DataFrame, text_col: str, shingle: int, least: Fraction) -> tuple[DataFrame, DataFrame]:
    """(sets, label): for each sid its first row; for each sid n (rows), first (of the set) and lowest (of its component)."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
    parts = max(8, int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = bucketed(marked.groupBy("sid").agg(F.min_by("row", order).alias("row"), F.min(order).alias("first"), *(F.first(c).alias(c) for c in ("fp", "size", "parity")), F.count("*").alias("n")), "similar-sets", "sid", parts)
    tidy(marked.sparkSession)
    links = similar_links(sets.where("sid <> 0").select("sid", "fp", "size", "parity", F.col("row")[text_col].alias("text")), shingle, least)
    label = sets.select("sid", "first", "n").join(connected_components(links).hint("merge"), F.col("sid") == F.col("node"), "left").select("sid", "first", "n", F.coalesce("component", "sid").alias("component"))
    lowest = label.groupBy("component").agg(F.min("first").alias("lowest"))
    return sets, written(label.join(lowest.hint("merge"), "component").select("sid", "n", "first", "lowest"), "similar-labels")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: Fraction = SIMILARITY) -> DataFrame:
    """(id, component_id) for every row of ``docs``: the smallest id reachable over pairs of at least ``least``.

    Texts with equal shingle sets are one set before any pair is looked at; all texts without a word are one group.
    Rows whose id is null get the component of their set; an empty table gives an empty result; other columns may
    have any name.
    """
    marked = written(_marked(docs, id_col, text_col, shingle), "similar", compression="zstd")
    _, label = _labelled(marked, text_col, shingle, least)
    return join_groups(marked.select("id", "sid"), label.select("sid", "n", F.col("lowest.id").alias("component_id")), "sid", "n").select(F.col("id").alias(id_col), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: Fraction = SIMILARITY) -> DataFrame:
    """One row of each group of ``similar_groups``, whole: that of the smallest id, of equal ids the first in the table.

    Rows without an id come after all others, so one stays only where its group has no row with an id. Repeated rows
    and texts without a word are groups like any other; an empty table gives an empty result.
    """
    sets, label = _labelled(_marked(docs, id_col, text_col, shingle), text_col, shingle, least)
    return sets.join(label.where(F.col("first") == F.col("lowest")).select("sid").hint("merge"), "sid", "left_semi").select("row.*")

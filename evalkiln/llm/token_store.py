"""Token ids on disk: blocks of ids, transposed into byte or bit planes, each plane compressed, with a chunk index.

Layout of a store, all of it written by Spark's own writers, so a lost executor leaves no partial file behind:

* ``<path>/chunks``: Parquet, one row per chunk. A chunk holds whole documents in order (doc_ids, doc_lens) and their
  ids as blocks of BLOCK_IDS; a block is an array of ``width`` planes, each a zstandard frame, least significant
  first. Plane p of a block has byte (or bit) p of every id of the block. A plane of zeros is stored empty.
* ``<path>/index``: Parquet, one row per chunk: shard, chunk, start (ids of the whole store before it), n_ids.

Shards are ranges of the document id, so the store as a whole is in ascending order of ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evalkiln.llm.common import filled, shared_path, small_batches

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 17
WIDTH = 32
#: Bytes of text in one shard.
SHARD_BYTES = 16 << 20
#: Texts between spaces whose ids a worker keeps.
CACHE = 500_000
#: Characters of the texts that are encoded in one go.
ENCODE_CHARS = 8_000_000
#: Parts that one call of the library encodes.
GROUP = 256
#: Stands between them; its bytes occur in no Latin text.
MARK = "\u2603"
CHUNKS = "shard int, chunk int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_lens array<int>, block_ids array<int>, bits boolean, planes array<array<binary>>"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of one block, compressed: 4 byte planes or 32 bit planes, the lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        rows = np.packbits(np.unpackbits(rows[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1).reshape(WIDTH, -1), axis=1)
    compress = zstandard.ZstdCompressor(level=3).compress
    return [compress(row.tobytes()) if row.any() else b"" for row in rows]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    size = (n + 7) // 8 if bits else n
    rows = np.vstack([np.frombuffer(expand(p), np.uint8) if len(p) else np.zeros(size, np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n].reshape(4, 8, n).transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _words_only(path: str):
    """The same vocabulary without added tokens, for the parts of texts that hold none."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


#: ASCII marks that may end a part; an apostrophe may start a word of the vocabulary's pattern.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


#: Letters whose lower case or normal form may end in a mark that isn't a letter, and all beyond Latin.
_UNUSUAL = re.compile("[^\u0000-\u024f]|\u0130")


class Encoder:
    """Ids of whole texts by a vocabulary that folds case and drops white space.

    Its normalisation and its words never reach across a space or line feed, so the ids of a text are those of the
    parts between them. A part that ends in marks after a letter or digit is two words, the marks being one. Parts are encoded
    once and kept, up to CACHE of them, for all tasks of a worker. A text that holds an added token of the vocabulary
    (such as an end mark) is encoded whole by the library.
    """

    def __init__(self, path: str):
        self.path, self.known = path, {"": b""}
        self.added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts. Latin ones go many to a call, with a mark between them whose first id no Latin text gives."""
        tokenizer = _words_only(self.path)
        mark = tokenizer.encode(MARK, add_special_tokens=False).ids
        odd = [p for p in parts if _UNUSUAL.search(p)]
        out = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(odd, tokenizer.encode_batch_fast(odd, add_special_tokens=False))}
        plain = [p for p in parts if p not in out]
        found = tokenizer.encode_batch_fast([f" {MARK} ".join([*plain[i : i + GROUP], ""]) for i in range(0, len(plain), GROUP)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
        ends = (4 * np.flatnonzero(ids == mark[0])).tolist()
        data, width = ids.tobytes(), 4 * len(mark)
        out.update(zip(plain, (data[i:j] for i, j in zip([0, *(e + width for e in ends)], ends))))
        return out

    def __call__(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end = np.array([end_id], "<u4").tobytes()
        whole = [i for i, x in enumerate(texts) if x and any(t in x for t in self.added)]
        if whole:
            found = _tokenizer(self.path).encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            apart = {i: np.array(e.ids, "<u4").tobytes() + end for i, e in zip(whole, found)}
            rest = iter(self([x for i, x in enumerate(texts) if i not in apart], end_id))
            return [apart[i] if i in apart else next(rest) for i in range(len(texts))]
        parts = [(x.lower() if x.isascii() or not _UNUSUAL.search(x) else x).replace("\n", " ").split(" ") if x else [] for x in texts]
        known = self.known
        own = {p: known.get(p) for p in set().union(*parts)}  # small, so that the many look-ups below stay near
        halves = {}
        for p in [p for p, ids in own.items() if ids is None]:
            core = p.rstrip(_MARKS)
            if core and len(core) < len(p) and core[-1].isalnum() and not _UNUSUAL.match(core[-1]):
                halves[p] = (core, p[len(core) :])
        for x in (x for pair in halves.values() for x in pair):
            if own.get(x) is None:
                own[x] = known.get(x)
        fresh = [p for p, ids in own.items() if ids is None]
        own.update(self._encode([p for p in fresh if p not in halves]))
        own.update((p, own[core] + own[marks]) for p, (core, marks) in halves.items())
        if len(known) < CACHE:
            known.update((p, own[p]) for p in fresh if len(p) <= 64)
        return [b"".join(map(own.__getitem__, ps)) + end for ps in parts]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Ids and texts of batches, put together up to ENCODE_CHARS: a word is encoded once in each such lot."""
    keys, texts, size = [], [], 0
    for pdf in batches:
        keys += pdf["i"].astype("Int64").tolist()
        texts += pdf["t"].tolist()
        size += int(pdf["t"].str.len().sum())
        if size >= ENCODE_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shards: int | None = None, bits: bool = False) -> None:
    """Encode every text whole and write the store.

    Null and empty texts have just the end id; texts are encoded whole. Rows of one id stay next to each other,
    ordered by a hash of the text; rows without an id come first; repeated rows stay. Other columns are not read. The
    texts are shuffled once, into ranges of id, hash and row number, so an id (or null) of very many rows fills many
    ranges. ``shards`` is their number, by default one for each SHARD_BYTES of text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    shards = shards or 1 + (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SHARD_BYTES

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard, first, chunk = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        own_ids: list = []
        own: list[bytes] = []
        size = 0

        def row() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(own), "<u4")
            blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
            values = [shard, chunk, first, len(ids), own_ids, [len(x) // 4 for x in own], [len(b) for b in blocks], bits, [to_planes(b, bits) for b in blocks]]
            return pd.DataFrame({c.split()[0]: [v] for c, v in zip(CHUNKS.split(", "), values)})

        for keys, texts in _gathered(filled(batches)):
            for i, ids in zip(keys, encode(texts, end_id)):
                own_ids.append(None if pd.isna(i) else int(i))
                own.append(ids)
                size += len(ids) // 4
                if size >= CHUNK_IDS:
                    yield row()
                    first, chunk, size = first + size, chunk + 1, 0
                    own_ids, own = [], []
        if own:
            yield row()

    rows = rows.withColumns({"h": F.xxhash64("t"), "n": F.monotonically_increasing_id()}).repartitionByRange(shards, "i", "h", "n").sortWithinPartitions("i", "h", "n").select("i", "t")
    rows.mapInPandas(pack, CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    index = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "first", "n_ids")
    index.join(F.broadcast(_shard_starts(index)), "shard").select("shard", "chunk", (F.col("before") + F.col("first")).alias("start"), "n_ids").write.parquet(f"{path}/index")


def _shard_starts(index: DataFrame) -> DataFrame:
    """(shard, before): ids before each shard. One row for each SHARD_BYTES of text: 100 TB make 6 million rows of 16 bytes, which may be broadcast."""
    total = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return total.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


#: What ``read_tokens`` can give of a document's ids: themselves as little-endian unsigned 32-bit numbers, their CRC-32.
CONTENT = {"ids": "binary", "ids_crc32": "bigint"}


def read_tokens(spark: SparkSession, path: str, content: str = "ids") -> DataFrame:
    """(doc_id, start, n_tokens, content): every document of a store, with one of CONTENT.

    Documents without text have their end id; repeated rows and rows without an id come back as they were written; an
    empty store gives no rows.
    """
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    index = spark.read.schema("shard int, chunk int, start bigint, n_ids bigint").parquet(f"{path}/index")
    before = index.where("chunk = 0").select("shard", F.col("start").alias("before"))  # one row per shard
    rows = chunks.join(F.broadcast(before), "shard").withColumn("first", F.col("first") + F.col("before")).drop("before")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            for r in pdf.itertuples(index=False):
                ids = np.concatenate([from_planes(list(p), n, r.bits) for p, n in zip(r.planes, r.block_ids)]).tobytes()
                ends = np.cumsum(np.asarray(r.doc_lens, np.int64))
                starts = ends - r.doc_lens
                own = (ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist()))
                yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), "Int64"), "start": starts + r.first, "n_tokens": np.asarray(r.doc_lens, np.int64), content: list(own if content == "ids" else map(zlib.crc32, own))})

    return rows.mapInPandas(unpack, f"doc_id bigint, start bigint, n_tokens bigint, {content} {CONTENT[content]}")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, "ids_crc32")

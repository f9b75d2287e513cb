"""Seeds and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def seed_hash(seed: int, label: str, ids: Column, parts: tuple[str, ...] = ()) -> Column:
    """SHA-256 (hex) of the seed (8 bytes, little endian), each part after a 00, the label, FF and the id.

    The order of the bytes is the one that seeded splits are defined by.
    """
    pieces = [F.unhex(F.lit(seed.to_bytes(8, "little").hex()))]
    for part in (*parts, label):
        pieces += [F.unhex(F.lit("00")), F.lit(part).cast("binary")]
    return F.sha2(F.concat(*pieces, F.unhex(F.lit("FF")), ids.cast("binary")), 256)


def little_endian_key(digest: Column) -> Column:
    """The first 8 bytes of a hex digest read as a little-endian number, as 16 hex digits: string order is unsigned order."""
    # bound to a variable, so that the digest is computed once
    return F.transform(F.array(digest), lambda d: F.concat(*[F.substring(d, 15 - 2 * i, 2) for i in range(8)]))[0]


def seed_key(seed: int, label: str, ids: Column, parts: tuple[str, ...] = ()) -> Column:
    return little_endian_key(seed_hash(seed, label, ids, parts))


def row_fingerprint(*cols: Column | str) -> Column:
    """SHA-256 of the JSON of the columns, in their order."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """One row (n_rows, fingerprint) that doesn't depend on the order of rows.

    The digests of rows are summed by four 32-bit limbs, so nothing is collected and repeated rows count.
    """
    cols = cols or tuple(sorted(df.columns))
    rows = df.select(row_fingerprint(*cols).alias("h"))
    limbs = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    total = rows.agg(F.count("*").alias("n_rows"), *limbs)
    return total.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)]), 256).alias("fingerprint"))

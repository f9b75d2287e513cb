"""Counter-based random numbers: the same for a row at any parallelism, and without any state.

A row's identity is encoded with types and lengths, so that no two identities share an encoding; the first 16 bytes of
the SHA-256 are the counter, the seed is the key of a Philox4x32-10 block.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F

DOMAIN = b"evalkiln-counter\0"
#: Fixed values of Philox4x32-10.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
WEYL = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
MASK = 2**32 - 1


def _raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def _length(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def text(c: Column) -> Column:
    """S, the length of the UTF-8 bytes (8 bytes), the bytes; N for null."""
    return F.when(c.isNull(), _raw(b"N")).otherwise(F.concat(_raw(b"S"), _length(F.octet_length(c)), c.cast("binary")))


def integer(c: Column) -> Column:
    """I, the length of the decimal digits, the digits; N for null."""
    digits = c.cast("bigint").cast("string")
    return F.when(c.isNull(), _raw(b"N")).otherwise(F.concat(_raw(b"I"), _length(F.length(digits)), digits.cast("binary")))


def number(value: float) -> Column:
    """D and the 8 bytes of a double, big endian; minus zero is zero."""
    return _raw(b"D" + struct.pack(">d", value + 0.0))


def sequence(*members: Column) -> Column:
    return F.concat(_raw(b"A" + struct.pack(">Q", len(members))), *members)


def counter_words(identity: Column, domain: bytes = DOMAIN) -> Column:
    """The four 32-bit words of the counter, as an array<bigint>."""
    digest = F.sha2(F.concat(_raw(domain), identity), 256)
    return F.transform(F.array(digest), lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]))[0]


def _product(multiplier: int, word: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a product, from 16-bit halves so that no step exceeds 63 bits."""
    low, high = word.bitwiseAND(F.lit(0xFFFF)) * F.lit(multiplier), F.shiftright(word, 16) * F.lit(multiplier)
    middle = high + F.shiftright(low, 16)
    return F.shiftright(middle, 16), F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))


def philox(counter: Column, seed: int) -> Column:
    """The block of four 32-bit words (array<bigint>) for a counter of four words."""
    key = (seed & MASK, seed >> 32 & MASK)
    keys = F.array(*[F.struct(*[F.lit((key[j] + r * WEYL[j]) & MASK).cast("bigint").alias(f"k{j}") for j in (0, 1)]) for r in range(ROUNDS)])

    def turn(c: Column, k: Column) -> Column:
        hi0, lo0 = _product(MULTIPLIERS[0], F.get(c, F.lit(0)))
        hi1, lo1 = _product(MULTIPLIERS[1], F.get(c, F.lit(2)))
        return F.array(hi1.bitwiseXOR(F.get(c, F.lit(1))).bitwiseXOR(k["k0"]), lo1, hi0.bitwiseXOR(F.get(c, F.lit(3))).bitwiseXOR(k["k1"]), lo0)

    return F.aggregate(keys, counter, turn)


def uniform(block: Column) -> Column:
    """A double in [0, 1) from the first 53 bits of a block."""
    return (F.get(block, F.lit(0)) * F.lit(2**21) + F.shiftright(F.get(block, F.lit(1)), 11)).cast("double") / F.lit(float(2**53))

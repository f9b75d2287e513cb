import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from evalkiln.functions import counter_rng as C


@pytest.mark.parametrize(
    "counter, seed, want",
    [
        ((0, 0, 0, 0), 0, "6627e8d5e169c58dbc57ac4c9b00dbd8"),
        ((2**32 - 1,) * 4, 2**64 - 1, "408f276d41c83b0ea20bc7c66d5451fd"),
        ((0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344), 0x299F31D0A4093822, "d16cfe0994fdcceb5001e42024126ea1"),
    ],
)
def test_known_answers(spark, counter, seed, want):
    block = spark.range(1).select(C.philox(F.array(*[F.lit(c).cast("bigint") for c in counter]), seed)).first()[0]
    assert "".join(f"{w:08x}" for w in block) == want


def test_counter_is_the_digest_of_the_encoding(spark):
    df = spark.createDataFrame([("é", 7), (None, None)], "u string, i bigint")
    got = df.select(C.counter_words(C.sequence(C.text(F.col("u")), C.number(-0.0), C.integer(F.col("i"))))).collect()

    def text(b):
        return b"S" + struct.pack(">Q", len(b)) + b

    for row, members in zip(got, ([text("é".encode()), b"I" + struct.pack(">Q", 1) + b"7"], [b"N", b"N"])):
        data = b"A" + struct.pack(">Q", 3) + members[0] + b"D" + bytes(8) + members[1]
        assert list(row[0]) == list(struct.unpack(">4I", hashlib.sha256(C.DOMAIN + data).digest()[:16]))

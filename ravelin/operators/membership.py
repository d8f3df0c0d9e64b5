"""Keys that may be among given ones: a Bloom filter as one binary constant, so that rows, or items of arrays, are dropped before they are joined."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a constant at most, 8 MiB, and bits a key.
MOST_BITS, BITS_PER_KEY = 1 << 26, 12
#: A byte of the constant holds seven bits, so that it is a character; a row that is gathered holds LONGS numbers of LONG_BITS bits.
BYTE_BITS, LONG_BITS, LONGS = 7, 63, 7


class KeyFilter:
    """Of keys, a column of longs that are hashes already: all of them pass, and few others, while the constant has room for them. Null passes not."""

    def __init__(self, keys: DataFrame, key: str, most_bits: int = MOST_BITS):
        row = LONGS * LONG_BITS
        self.rows = max(1, math.ceil(min(most_bits, keys.count() * BITS_PER_KEY) / row))
        self.bits = self.rows * row
        at = keys.select(F.explode(F.array(*self.places(F.col(key)))).alias("at")).select((F.expr(f"at div {row}")).alias("row"), (F.col("at") % row).cast("int").alias("at"))
        bit = lambda j: F.when(F.expr(f"at div {LONG_BITS}") == j, F.expr(f"shiftleft(1L, at % {LONG_BITS})"))
        found = at.filter("at IS NOT NULL").groupBy("row").agg(*[F.coalesce(F.bit_or(bit(j)), F.lit(0)) for j in range(LONGS)]).collect()  # as many rows as the constant has room for
        longs = np.zeros((self.rows, LONGS), np.int64)
        for r in found:
            longs[r[0]] = r[1:]
        self.constant = ((longs[:, :, None] >> np.arange(0, LONG_BITS, BYTE_BITS)) & 127).astype(np.uint8).tobytes()

    def places(self, key: Column) -> list[Column]:
        """Three bits of a key."""
        return [F.pmod(key, F.lit(self.bits)), F.pmod(F.shiftright(key, 21), F.lit(self.bits)), F.pmod(F.shiftright(key, 42) * 2_654_435_761, F.lit(self.bits))]

    def passes(self, key: Column) -> Column:
        """Whether the key may be one of the given ones."""
        constant, out = F.lit(self.constant), F.lit(True)
        for at in self.places(key):
            byte = F.ascii(F.substring(constant, (at / BYTE_BITS).cast("int") + 1, F.lit(1)).cast("string"))
            out = out & (F.getbit(byte, (at % BYTE_BITS).cast("int")) == 1)
        return F.coalesce(out, F.lit(False))

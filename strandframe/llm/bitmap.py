"""A bitmap of hashes with a fixed largest size, built by Spark and broadcast.

False answers only let more rows through to an exact step, so a bitmap that
saturates at great sizes costs work, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 20, 1 << 29


class Bitmap:
    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in (hashes & self.mask, (hashes >> np.uint64(29)) & self.mask):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def build(hashes: DataFrame, count: int) -> Bitmap:
    """Of the column ``h`` of 64-bit hashes; 16 bits for each, up to MAX_BITS."""
    size = MIN_BITS
    while size < MAX_BITS and size < 16 * count:
        size *= 2
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 29).bitwiseAND(F.lit(size - 1))))
    pages = hashes.select(at.alias("i")).groupBy(F.shiftright("i", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("i").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in pages.collect():  # at most MAX_BITS bits in all
        out[row["page"] * 4096 : (row["page"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(out)

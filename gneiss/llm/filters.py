"""Bitmaps of hashes, of bounded size, that are sent to all tasks: never false for a hash that is among those they were built from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

#: The least and the most bits of a bitmap: 128 MB. Beyond, more hashes pass, and the joins behind stay exact.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
_PART = 1 << 15


def hash_filter(hashes: DataFrame, bits_each: int = 64) -> np.ndarray:
    """The bitmap of hashes (h), of so many bits for each, built by partial aggregates; the driver gets its parts only."""
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (bits_each * max(1, n) - 1).bit_length()))
    place = F.pmod(F.col("h"), F.lit(bits)).alias("p")
    parts = hashes.select(place).groupBy(F.expr(f"p div {_PART}").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % _PART).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # MOST_BITS / _PART rows at most
        own = np.frombuffer(row["bits"], np.uint8)
        out[_PART // 8 * row["k"] : _PART // 8 * row["k"] + len(own)] = own
    return out


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the bitmap."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def maybe_in(hashes: DataFrame, asked: Column) -> Column:
    """Whether a hash may be one of hashes (h). Rows that it leaves out need no join, so their texts aren't shuffled."""
    shared = hashes.sparkSession.sparkContext.broadcast(hash_filter(hashes))

    @F.pandas_udf(BooleanType())
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, h.to_numpy(np.int64)))

    return among(asked)

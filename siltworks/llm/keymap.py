"""A map of 64-bit keys, one bit each, of one size whatever the number of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits of a map.
WORDS = 1 << 20


def key_map(keys: DataFrame, column: str) -> np.ndarray:
    """The map of a column's keys. The bits are put together by word, so at most WORDS rows reach the driver; null keys are left out."""
    key = F.col(column)
    word = F.shiftright(key.bitwiseAND(F.lit(64 * WORDS - 1)), 6).cast("int")
    bit = F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))")
    rows = keys.where(key.isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(WORDS, np.uint64)
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that the map may hold: all that it holds, and others where bits agree."""
    at = (keys & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))

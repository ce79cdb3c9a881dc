"""Bit tables of hashes: a broadcast of bounded size that tells which rows can have a partner in a join.

A table has 64 bits a row and BITS at most; three places belong to every hash. Rows whose
places are not all set have no partner and need not be shuffled; false hits are dropped by
the join itself, so a table that is too full costs rows, never results.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
_SHIFTS = (3, 19, 36)


def hashed(word: str) -> int:
    """As xxhash64() of one string column, without the sign."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def table_of(rows: DataFrame, h: Column, most: int = BITS) -> np.ndarray:
    """The table of a column of hashes (bigint). It is put together in the executors; most / 32 rows come back."""
    bits = min(most, max(1 << 16, 1 << (64 * max(1, rows.count()) - 1).bit_length()))
    slots = F.array(*[F.shiftright(h, s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS])
    packed = rows.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 5).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[packed["k"].to_numpy(np.int64)] = packed["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def hits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes (unsigned) all of whose bits are set."""
    left = np.arange(len(h))
    for shift in _SHIFTS:
        slot = (h[left] >> np.uint64(shift)) & np.uint64(32 * len(table) - 1)
        left = left[(table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0]
    return left


def hit(table: np.ndarray, h: int) -> bool:
    """The same for one hash."""
    most = 32 * len(table) - 1
    return all(int(table[(h >> s & most) >> 5]) >> (h >> s & 31) & 1 for s in _SHIFTS)

"""Per-key scalar functions: ranges, sanitising, partition hashes, bit masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(key: Column, rows: int | Column) -> Column:
    """Whether a key addresses a row of a dense table; null and negative keys don't."""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    return F.coalesce((key >= 0) & (key < rows), F.lit(False))


def sanitize(key: Column, rows: int | Column, default_row: int) -> Column:
    """Keys out of range become ``default_row``; a negative default leaves them as they are."""
    return key if default_row < 0 else F.when(in_range(key, rows), key).otherwise(F.lit(default_row))


def _power_of_two(parts: int) -> int:
    if parts < 1 or parts & (parts - 1):
        raise ValueError("the number of partitions must be a power of two")
    return parts - 1


def partition_identity(key: Column, parts: int) -> Column:
    return key.bitwiseAND(F.lit(_power_of_two(parts)).cast("long"))


def partition_zero(key: Column, parts: int) -> Column:
    _power_of_two(parts)
    return key * 0


#: Fixed values of the published hash functions (FNV-1a, MurmurHash3 finaliser, rrxmrrxmsx_0).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MURMUR = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
RRX = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def fnv1a(x: np.ndarray) -> np.ndarray:
    """FNV-1a over the 8 bytes of each unsigned key, lowest first."""
    h = np.full(x.shape, FNV_OFFSET, np.uint64)
    for shift in range(0, 64, 8):
        h = (h ^ ((x >> np.uint64(shift)) & np.uint64(0xFF))) * np.uint64(FNV_PRIME)
    return h


def murmur3(x: np.ndarray) -> np.ndarray:
    for m in MURMUR:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


def rrxmrrxmsx(x: np.ndarray) -> np.ndarray:
    turn = lambda v, n: (v >> np.uint64(n)) | (v << np.uint64(64 - n))
    for (a, b), m in zip(((25, 50), (24, 49)), RRX, strict=True):
        x = (x ^ turn(x, a) ^ turn(x, b)) * np.uint64(m)
    return x ^ (x >> np.uint64(28))


HASHES = {"fowler_noll_vo": fnv1a, "murmur3": murmur3, "rrxmrrxmsx0": rrxmrrxmsx}


def partition_hash(key: Column, parts: int, kind: str = "fowler_noll_vo") -> Column:
    """The partition of a key under an unsigned 64-bit hash (Arrow batches: SQL arithmetic can't wrap); null stays null."""
    mask, fn = np.uint64(_power_of_two(parts)), HASHES[kind]

    @F.arrow_udf("long")
    def run(k: pa.Array) -> pa.Array:
        hashed = fn(k.fill_null(0).to_numpy().view(np.uint64)) & mask
        return pa.array(hashed.astype(np.int64), mask=k.is_null().to_numpy(zero_copy_only=False))

    return run(key.cast("long"))


def mask_bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(pos, F.lit(64)).cast("int"))


def mask_word(pos: Column) -> Column:
    return F.floor(pos / 64).cast("long")

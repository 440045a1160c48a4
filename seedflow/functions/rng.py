"""Counter-based randomness: a coin is a hash of what it decides about, so results do not depend on
partitioning, order or retries, and SQL, Spark and numpy agree bit for bit.

All values are 32-bit numbers in BIGINTs; products stay below 2^63.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
ONE = 1 << 32
#: Multipliers of the mixer (odd, below 2^31).
MUL_1, MUL_2 = 0x2C1B3C6D, 0x297A2D39

#: What a coin is for.
SALTS = {"weight": 1, "root": 2, "edge": 3, "vertex": 4, "r1": 5, "r2": 6, "simulation": 7, "rest": 8, "sample": 9, "rank": 10, "race": 11}


def fold_int(h: int, key: int) -> int:
    h = (h + key) & MASK
    h ^= h >> 15
    h = h * MUL_1 & MASK
    h ^= h >> 12
    h = h * MUL_2 & MASK
    return h ^ h >> 15


def salted(purpose: str, seed: int = 0) -> int:
    """The start of a chain of folds for one purpose."""
    return fold_int(fold_int(1, SALTS[purpose]), seed) if seed else fold_int(1, SALTS[purpose])


def fold_np(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    m = np.uint64(MASK)
    h = (h.astype(np.uint64) + np.asarray(key).astype(np.uint64)) & m
    h ^= h >> np.uint64(15)
    h = h * np.uint64(MUL_1) & m
    h ^= h >> np.uint64(12)
    h = h * np.uint64(MUL_2) & m
    return h ^ h >> np.uint64(15)


def fold_u32(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The same in 32-bit arrays, whose arithmetic wraps round."""
    h = h + key
    h ^= h >> np.uint32(15)
    h *= np.uint32(MUL_1)
    h ^= h >> np.uint32(12)
    h *= np.uint32(MUL_2)
    h ^= h >> np.uint32(15)
    return h


def fold(h: Column | int, key: Column | int) -> Column:
    as_col = lambda v: F.lit(v).cast("long") if isinstance(v, int) else v.cast("long")

    def shifted(c: Column, by: int) -> Column:
        return c.bitwiseXOR(F.shiftrightunsigned(c, by))

    a = shifted((as_col(h) + as_col(key)).bitwiseAND(F.lit(MASK)), 15)
    b = shifted((a * F.lit(MUL_1).cast("long")).bitwiseAND(F.lit(MASK)), 12)
    return shifted((b * F.lit(MUL_2).cast("long")).bitwiseAND(F.lit(MASK)), 15)


def fold_sql(h: str | int, key: str | int) -> str:
    """The same as DuckDB SQL; name long operands in a subquery first, each is repeated eight times."""

    def shifted(c: str, by: int) -> str:
        return f"xor({c}, ({c}) >> {by})"

    a = shifted(f"((({h}) + ({key}))::BIGINT & {MASK})", 15)
    b = shifted(f"(({a} * {MUL_1}) & {MASK})", 12)
    return shifted(f"(({b} * {MUL_2}) & {MASK})", 15)

"""Hashes of columns.

``xxhash64`` is built in and the default. ``md5`` gives the same 60 bits in any SQL engine, for
results that are compared with one. ``murmur3`` (vectorised in numpy) gives the 63-bit
hashes that Spark's own theta sketches hold, so relational and native sketches mix.

Nulls hash to null. Empty strings are items like others here; drop them beforehand where
they should not count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.kernels.hashing import SEED, murmur_bytes, murmur_doubles, murmur_longs

MAX_HASH = (1 << 63) - 1
__all__ = ["MAX_HASH", "address", "hash63", "leading_value", "md5_60", "murmur3_theta"]


def md5_60(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("long")


def murmur3_theta(col: Column, kind: str, seed: int = SEED) -> Column:
    """The hash that a theta sketch keeps: the first half of murmur3, shifted right by one. kind: long, double or string."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype="Int64")
        ok = s.notna().to_numpy() if kind != "double" else np.ones(len(s), bool)
        v = s[ok]
        if kind == "long":
            h = murmur_longs(v.to_numpy(np.int64), seed)[0]
        elif kind == "double":
            h = murmur_doubles(v.to_numpy(np.float64), seed)[0]
        else:
            h = np.array([murmur_bytes(x.encode(), seed)[0] for x in v], np.uint64)
        out[ok] = (h >> np.uint64(1)).astype(np.int64)
        return out

    return of(col.cast(kind))


def hash63(col: Column, how: str = "xxhash64") -> Column:
    """A hash in 0 .. 2**63 - 1; integers of any width and dates hash as longs and strings."""
    if how == "xxhash64":
        return F.when(col.isNotNull(), F.xxhash64(col).bitwiseAND(F.lit(MAX_HASH)))
    if how == "md5":
        return md5_60(col) * 8
    if how in ("murmur3", "murmur3:long"):
        return murmur3_theta(col, "long")
    if how in ("murmur3:double", "murmur3:string"):
        return murmur3_theta(col, how.split(":")[1])
    raise ValueError(f"no hash named {how}")


ADDRESS_BITS, VALUE_BITS = 26, 34


def address(h: Column, lg_k: int) -> Column:
    """A register's number, from the low bits after the three that md5 leaves 0."""
    return F.pmod(F.shiftright(h, 3), F.lit(1 << lg_k))


def leading_value(h: Column) -> Column:
    """1 + leading zeros of the 34 bits above the address bits: 1 with probability 1/2, and so on."""
    x = F.shiftright(h, 3 + ADDRESS_BITS)
    return F.when(x == 0, F.lit(VALUE_BITS + 1)).otherwise(F.lit(VALUE_BITS + 1) - F.length(F.bin(x))).cast("int")

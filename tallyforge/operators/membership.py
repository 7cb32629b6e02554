"""Bloom filters: rows (bit), at most as many as the filter has bits, or packed words for probing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import hash63
from tallyforge.kernels.intervals import bloom_sizes

#: Packed filters of up to so many bits go to every task (32 MB); larger ones are joined.
MOST_BROADCAST_BITS = 1 << 28
#: Bits that a task packs as one value (8 KB): 4096 values of the largest filter.
CHUNK_BITS = 1 << 16


def pair(item: Column, how: str = "xxhash64") -> list[Column]:
    """The two hashes from which an item's bits follow, of its text form."""
    return [F.pmod(hash63(F.concat(F.lit(f"{i}:"), item.cast("string")), how), F.lit(1 << 48)) for i in (0, 1)]


def indexes(item: Column, bits: int, hashes: int, how: str = "xxhash64") -> Column:
    """The item's bits: ((h0 + i * h1) >> 1) mod bits, i = 1..hashes, in 48-bit arithmetic."""
    h0, h1 = pair(item, how)
    return F.array(*[F.pmod(F.shiftright(h0 + h1 * i, 1), F.lit(bits)) for i in range(1, hashes + 1)])


def build(df: DataFrame, item: str, expected: int = 10_000, false_positives: float = 0.01, how: str = "xxhash64") -> DataFrame:
    """The bits that are set. Null items are ignored."""
    bits, hashes = bloom_sizes(expected, false_positives)
    return df.where(F.col(item).isNotNull()).select(F.explode(indexes(F.col(item), bits, hashes, how)).alias("bit")).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "bit", "left_semi")


def invert(a: DataFrame, bits: int) -> DataFrame:
    return a.sparkSession.range(bits).withColumnRenamed("id", "bit").join(a, "bit", "left_anti")


def packed(filter_bits: DataFrame, bits: int) -> np.ndarray:
    """The filter as bytes on the driver; only for at most MOST_BROADCAST_BITS bits.

    Tasks pack whole chunks, so that little more than the filter's own bytes reach the driver.
    """
    if bits > MOST_BROADCAST_BITS:
        raise ValueError("this filter is too large to be packed")

    size = CHUNK_BITS // 8
    chunks = -(-bits // CHUNK_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met = np.zeros(chunks * size, np.uint8), np.zeros(chunks, bool)
        for batch in batches:
            bit = batch.column(0).to_numpy()
            np.bitwise_or.at(own, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
            met[bit // CHUNK_BITS] = True
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([own[i * size : (i + 1) * size].tobytes() for i in at], pa.binary())], ["chunk", "data"])

    whole = filter_bits.select("bit").repartition(F.floor(F.col("bit") / CHUNK_BITS)).mapInArrow(pack, "chunk long, data binary").toArrow()
    out = np.zeros((chunks, size), np.uint8)
    for at, data in zip(whole.column("chunk").to_pylist(), whole.column("data"), strict=True):
        out[at] = np.frombuffer(data.as_buffer(), np.uint8)
    return out.ravel()[: -(-bits // 8)]


def probe(df: DataFrame, item: str, filter_bits: DataFrame, expected: int = 10_000, false_positives: float = 0.01, how: str = "xxhash64") -> DataFrame:
    """df with maybe: false means certainly not in the filter. A null item is in no filter.

    A filter of MOST_BROADCAST_BITS goes to every task once, as bytes, and two hashes of each
    item are looked up there; larger ones are joined.
    """
    bits, hashes = bloom_sizes(expected, false_positives)
    if bits <= MOST_BROADCAST_BITS:
        shared = df.sparkSession.sparkContext.broadcast(packed(filter_bits, bits))

        @F.pandas_udf("boolean")
        def found(a: pd.Series, b: pd.Series) -> pd.Series:
            known = shared.value
            h0, h1 = a.fillna(0).to_numpy(np.int64), b.fillna(0).to_numpy(np.int64)
            hit = a.notna().to_numpy()
            for i in range(1, hashes + 1):
                at = ((h0 + h1 * i) >> 1) % bits
                hit &= (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            return pd.Series(hit)

        return df.withColumn("maybe", found(*pair(F.col(item), how)))
    ix = lambda c: indexes(c, bits, hashes, how)
    keyed = df.select(F.col(item).alias("__i")).where("__i is not null").distinct()
    all_set = keyed.select("__i", F.explode(ix(F.col("__i"))).alias("bit")).distinct()
    missing = all_set.join(filter_bits, "bit", "left_anti").select("__i").distinct()
    miss = missing.withColumn("__miss", F.lit(True))
    return df.join(miss, df[item] == miss["__i"], "left").withColumn("maybe", F.col("__miss").isNull() & F.col(item).isNotNull()).drop("__i", "__miss")


def capacity(expected: int, false_positives: float) -> tuple[int, int]:
    """(bits, hashes) of a filter for so many items."""
    return bloom_sizes(expected, false_positives)


def reset(filter_bits: DataFrame) -> DataFrame:
    """The filter without its items."""
    return filter_bits.where(F.lit(False))


def is_empty(filter_bits: DataFrame) -> bool:
    return filter_bits.isEmpty()


def bits_used(filter_bits: DataFrame) -> DataFrame:
    return filter_bits.agg(F.count("*").alias("bits_used"))


def query_and_update(df: DataFrame, item: str, filter_bits: DataFrame, expected: int = 10_000, false_positives: float = 0.01, how: str = "xxhash64") -> tuple[DataFrame, DataFrame]:
    """(df with maybe, as the filter was before; the filter with df's items)."""
    return probe(df, item, filter_bits, expected, false_positives, how), union(filter_bits, build(df, item, expected, false_positives, how))


def compatible(a: tuple[int, float], b: tuple[int, float]) -> bool:
    """Whether filters of these (expected, false_positives) can be combined: same bits and hashes."""
    return bloom_sizes(*a) == bloom_sizes(*b)

"""The least hashes of each group, without moving all of them.

Each task keeps the k + 1 least distinct hashes of each group that it meets, tasks that share a
group's slice of hash space do so again, and only what is left meets per group: SLICES * (k + 1)
rows at most, however many rows and tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64
#: Rows that a task holds before it cuts them, and after that before it hands them on uncut by later ones.
HELD = 1 << 20


def _cut(t: pa.Table, keys: list[str], most: int) -> pa.Table:
    group = np.zeros(len(t), np.int64)
    for c in keys:
        own = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = np.unique(group * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    h = t.column("hash").to_numpy()
    order = np.lexsort((h, group))
    g, h = group[order], h[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    order, g = order[new], g[new]
    start = np.searchsorted(g, g)
    return t.take(pa.array(order[np.arange(len(g)) - start < most]))


def least(keys: list[str], k: int):
    """For mapInArrow: rows (keys, hash, ...) to those among the k + 1 least distinct hashes of their group here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                t = _cut(pa.Table.from_batches(held), keys, k + 1)
                if len(t) > HELD // 2:
                    yield from t.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = t.to_batches(), len(t)
        if rows:
            yield from _cut(pa.Table.from_batches(held), keys, k + 1).to_batches()

    return run


def least_hashes(hashes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, hash): distinct, at most SLICES * (k + 1) for each group, its k + 1 least ones among them."""
    schema = hashes.schema
    first = hashes.mapInArrow(least(keys, k), schema)
    # a task hands on what it cannot cut, so equal hashes of several tasks are first made one, in the same shuffle
    salted = first.withColumn("__salt", F.pmod(F.xxhash64("hash"), F.lit(SLICES))).repartition(*keys, "__salt")
    return salted.dropDuplicates([*keys, "__salt", "hash"]).select(*schema.names).mapInArrow(least(keys, k), schema)


def thresholds(hashes: DataFrame, keys: list[str], k: int, start: int) -> DataFrame:
    """(keys, theta): the (k + 1)st least distinct hash of each group, or start for a group with fewer."""
    w = Window.partitionBy(*keys).orderBy("hash")
    placed = least_hashes(hashes, keys, k).withColumn("__place", F.row_number().over(w))
    return placed.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__place") == k + 1, F.col("hash"))), F.lit(start)).cast("long").alias("theta"))

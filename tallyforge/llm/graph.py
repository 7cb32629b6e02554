"""Connected components of an edge table, by alternating large and small stars.

Tasks first contract the edges they hold to stars. A round is two grouped minima and two
joins; its edges are written, so the plan stays short and a lost executor costs one round. No
component and no list of neighbours is ever gathered in one place: a task contracts CHUNK edges
at a time, whatever components they belong to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written

CHUNK = 1 << 20


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least connected node of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars around the least node of each part that they connect."""
    held: list[pa.RecordBatch] = []
    n = 0

    def stars() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = np.asarray(t.column("a")), np.asarray(t.column("b"))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[roots(len(nodes), place[: len(a)], place[len(a) :])]
        far = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars()
            held, n = [], 0
    if held:
        yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    return written(edges.where(F.col("a") != F.col("b")).distinct().mapInArrow(_contract, "a long, b long"), "edges")


def _done(edges: DataFrame) -> bool:
    """Every node but the roots has one edge, to a root."""
    side = lambda c, out: F.struct(F.col(c).alias("x"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    ends = edges.select(F.explode(F.array(side("a", 1), side("b", 0))).alias("e")).select("e.*")
    odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out > 0 AND into > 0)")
    return odd.agg(F.count("*")).first()[0] == 0


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): every node of edges (a, b: long), with the least node it is connected to."""
    now = _stars(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while not _done(now):
        # large stars: greater neighbours go to the least one; then smaller neighbours do
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = _stars(small)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())

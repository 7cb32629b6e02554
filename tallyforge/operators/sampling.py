"""Uniform and weighted samples of a fixed size, with subset sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.kernels import intervals
from tallyforge.kernels.sampling import varopt as _varopt


#: Tasks that thin the first tasks' samples out before one takes the rest: MIDDLE * k rows.
MIDDLE = 64


def reservoir(df: DataFrame, k: int, keys: list[str] | None = None, order: Column | None = None, seed: int = 42) -> DataFrame:
    """k rows of df (of each group) with __draw, by the least of a random number.

    order may be a hash column, which makes the draw repeatable and lets samples of parts merge:
    the k least of their union are a sample of the whole.
    """
    drawn = df.withColumn("__draw", F.rand(seed) if order is None else order)
    if not keys:
        return drawn.orderBy("__draw").limit(k)
    w = Window.partitionBy(*keys).orderBy("__draw")
    return drawn.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= k).drop("__place")


def reservoir_union(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    return a.unionByName(b).orderBy("__draw").limit(k)


def reservoir_weighted_union(a: DataFrame, seen_a: int, b: DataFrame, seen_b: int, k: int, seed: int = 42) -> DataFrame:
    """A sample of k of two streams from their samples alone, without their draws.

    Each row of a sample stands for seen / size rows; the k least of -log(u) / weight are a sample by weight.
    """
    sides = []
    for rows, seen in ((a, seen_a), (b, seen_b)):
        size = rows.count()
        sides.append(rows.drop("__draw").withColumn("__weight", F.lit(seen / size if size else 0.0)))
    both = sides[0].unionByName(sides[1])
    return both.withColumn("__draw", -F.log(F.greatest(F.rand(seed), F.lit(1e-300))) / F.col("__weight")).orderBy("__draw").limit(k).drop("__weight")


def subset_sum(sample: DataFrame, n_seen: int, predicate: Column) -> tuple[float, float, float, float]:
    """(lower, estimate, upper, total) of how many of n_seen rows fit, from a uniform sample."""
    r = sample.agg(F.count("*").alias("n"), F.sum(F.when(predicate, 1).otherwise(0)).alias("m")).first()
    n, m = r["n"], r["m"] or 0
    if n == 0 or n >= n_seen:
        return float(m), float(m), float(m), float(n_seen)
    low, est, high = intervals.subset_sum(m * n_seen / n, float(n_seen), m, n, float(n_seen))
    return low, est, high, float(n_seen)


def threshold(df: DataFrame, weight: str, k: int) -> DataFrame:
    """(tau, n_heavy, n_rows): sum(min(1, w / tau)) = k. Only the k greatest weights meet in a task."""
    w = df.where(F.col(weight) > 0).select(F.col(weight).cast("double").alias("w"))
    total = w.agg(F.sum("w").alias("total"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("w").desc())
    top = w.orderBy(F.col("w").desc()).limit(k).select("w", (F.row_number().over(order) - 1).alias("h"), F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"))
    tried = top.crossJoin(F.broadcast(total)).select("h", "w", "n_rows", ((F.col("total") - F.col("above")) / (F.lit(k) - F.col("h"))).alias("tau"))  # one row
    first = tried.where((F.col("w") < F.col("tau")) | (F.col("h") == k - 1)).agg(F.min(F.struct("h", "tau")).alias("x"))
    few = F.col("n_rows") <= k
    return total.crossJoin(F.broadcast(first)).select(F.when(few, F.lit(0.0)).otherwise(F.col("x.tau")).alias("tau"), F.when(few, F.col("n_rows")).otherwise(F.col("x.h").cast("long")).alias("n_heavy"), "n_rows")  # one row each


def varopt(df: DataFrame, weight: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of df with __weight: heavy rows keep theirs, the others stand for tau each.

    Every task reduces its batches to k rows, then groups of tasks, then all: each step samples
    the union of samples by their adjusted weights. Rows whose weight is null or not positive are left out.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__weight", T.DoubleType())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            places, adjusted = _varopt(np.asarray(t.column("__weight")), k, rng)
            t = t.take(pa.array(places))
            held = t.set_column(t.schema.get_field_index("__weight"), "__weight", pa.array(adjusted, pa.float64())).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    first = df.where(F.col(weight) > 0).withColumn("__weight", F.col(weight).cast("double")).mapInArrow(reduce, schema)
    return first.repartition(MIDDLE).mapInArrow(reduce, schema).repartition(1).mapInArrow(reduce, schema)


def varopt_subset_sum(sample: DataFrame, predicate: Column) -> tuple[float, float, float, float]:
    """(lower, estimate, upper, total) of the weight of rows that fit."""
    light = F.col("__weight") <= F.min("__weight").over(Window.partitionBy())
    rows = sample.withColumn("__light", light)
    r = rows.agg(F.sum("__weight").alias("all"), F.sum(F.when(predicate & ~F.col("__light"), F.col("__weight"))).alias("heavy"), F.sum(F.when(F.col("__light"), F.col("__weight"))).alias("rest"), F.sum(F.when(F.col("__light"), 1)).alias("n"), F.sum(F.when(predicate & F.col("__light"), 1)).alias("m")).first()
    heavy, rest, n, m = (r[c] or 0 for c in ("heavy", "rest", "n", "m"))
    if not n:
        return heavy, heavy, heavy, r["all"] or 0.0
    low, high = intervals.proportion_lower(n, m, 2.0), intervals.proportion_upper(n, m, 2.0)
    return heavy + low * rest, heavy + m / n * rest, heavy + high * rest, r["all"]


def varopt_union(a: DataFrame, b: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """A sample of k of the union of two samples: their adjusted weights are sampled again."""
    both = a.unionByName(b).withColumnRenamed("__weight", "__before")
    return varopt(both, "__before", k, seed).drop("__before")


def weighted(sample: DataFrame, seen: int) -> DataFrame:
    """A uniform sample as a weighted one: each row stands for seen / size rows."""
    size = sample.count()
    return sample.drop("__draw").withColumn("__weight", F.lit(seen / size if size else 0.0))

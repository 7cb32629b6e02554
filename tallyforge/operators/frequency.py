"""Heavy hitters and point frequencies.

The relational heavy-hitter summary is exact counts cut to a capacity: the greatest counter that
was cut is the offset, so counter <= truth <= counter + offset holds for every item, also after
merges, and results do not depend on partitions. Count-Min is rows (row, bucket, w).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import hash63
from tallyforge.kernels.intervals import countmin_sizes

#: Rows that bounded counters take in at a time.
SLICE = 8192
NO_FALSE_POSITIVES, NO_FALSE_NEGATIVES = "no_false_positives", "no_false_negatives"


def _cut(counts: DataFrame, capacity: int, before: int = 0) -> tuple[DataFrame, int]:
    top = counts.orderBy(F.col("cnt").desc(), "item").limit(capacity + 1).withColumn("place", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "item")))
    over = top.where(F.col("place") == capacity + 1).select("cnt").first()
    return top.where(F.col("place") <= capacity).drop("place"), before + (over["cnt"] if over else 0)


def build(df: DataFrame, item: str, capacity: int, weight: str | None = None) -> tuple[DataFrame, int]:
    """((item, cnt) rows, offset). Null items are ignored; weights must not be negative."""
    w = F.lit(1).cast("long") if weight is None else F.when(F.col(weight) >= 0, F.col(weight)).otherwise(F.raise_error(F.lit("a weight is negative")))
    return _cut(df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.sum(w).alias("cnt")), capacity)


def _thinned(counts: dict, capacity: int) -> tuple[dict, int]:
    """The counters above the (capacity + 1)st greatest count, less that count, and the count itself."""
    if len(counts) <= capacity:
        return counts, 0
    n = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    return {x: c - cut for x, c in counts.items() if c > cut}, cut


def build_bounded(df: DataFrame, item: str, capacity: int, weight: str | None = None) -> tuple[DataFrame, int]:
    """((item, cnt) rows, offset) with at most 2 * capacity + SLICE counters in a task, whatever the number of items.

    A task that holds twice the capacity subtracts the (capacity + 1)st greatest count from all and drops what is
    not above it; what was subtracted is part of the offset, so cnt <= truth <= cnt + offset. The offset is
    at most all weight / (capacity + 1) for each task's share, and offsets add up over tasks.
    """
    w = F.lit(1).cast("long") if weight is None else F.when(F.col(weight) >= 0, F.col(weight)).otherwise(F.raise_error(F.lit("a weight is negative")))
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), w.cast("long").alias("cnt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        lost = 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                one = pa.Table.from_batches([part]).group_by("item").aggregate([("cnt", "sum")])
                for x, c in zip(one.column("item").to_pylist(), one.column("cnt_sum").to_pylist(), strict=True):
                    held[x] = held.get(x, 0) + c
                if len(held) > 2 * capacity:
                    held, cut = _thinned(held, capacity)
                    lost += cut
        if kind is not None:
            held, cut = _thinned(held, capacity)
            lost += cut
            # the row without an item has what the task subtracted
            yield pa.RecordBatch.from_arrays([pa.array([*held, None], kind), pa.array([*held.values(), lost], pa.int64())], ["item", "cnt"])

    kind = rows.schema["item"].dataType.simpleString()
    merged = rows.mapInArrow(run, f"item {kind}, cnt long").groupBy("item").agg(F.sum("cnt").alias("cnt"))
    kept = merged.where("item IS NOT NULL")
    lost = merged.where("item IS NULL").agg(F.sum("cnt")).first()[0] or 0
    top, offset = _cut(kept, capacity)
    return top, offset + lost


def merge(a: tuple[DataFrame, int], b: tuple[DataFrame, int], capacity: int) -> tuple[DataFrame, int]:
    return _cut(a[0].unionByName(b[0]).groupBy("item").agg(F.sum("cnt").alias("cnt")), capacity, a[1] + b[1])


def rows(summary: tuple[DataFrame, int]) -> DataFrame:
    """(item, estimate, lb, ub); an item that is not held has estimate and lb 0 and ub offset."""
    counts, offset = summary
    return counts.select("item", (F.col("cnt") + offset).alias("estimate"), F.col("cnt").alias("lb"), (F.col("cnt") + offset).alias("ub"))


def frequent(summary: tuple[DataFrame, int], threshold: int | None = None, errors: str = NO_FALSE_POSITIVES) -> DataFrame:
    """Items whose lower (or, without false negatives, upper) bound reaches the threshold."""
    at = max(threshold or 0, summary[1])
    return rows(summary).where(F.col("lb" if errors == NO_FALSE_POSITIVES else "ub") >= at)


def build_by(df: DataFrame, keys: list[str], item: str, capacity: int, weight: str | None = None) -> DataFrame:
    """(keys, item, cnt, offset): a summary for each group; what is cut in a group is its offset."""
    w = F.lit(1).cast("long") if weight is None else F.when(F.col(weight) >= 0, F.col(weight)).otherwise(F.raise_error(F.lit("a weight is negative")))
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, F.col(item).alias("item")).agg(F.sum(w).alias("cnt"))
    return _cut_by(counts.withColumn("before", F.lit(0).cast("long")), keys, capacity)


def _cut_by(counts: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), "item")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= capacity + 1)
    over = F.coalesce(F.max(F.when(F.col("place") == capacity + 1, F.col("cnt"))).over(Window.partitionBy(*keys)), F.lit(0))
    return top.withColumn("offset", F.col("before") + over).where(F.col("place") <= capacity).select(*keys, "item", "cnt", "offset")


def merge_by(a: DataFrame, b: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Groups of both; a group's offsets add up."""
    both = a.unionByName(b)
    sides = [s.groupBy(*keys).agg(F.max("offset").alias("o")) for s in (a, b)]
    total = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("o").alias("before"))
    return _cut_by(both.groupBy(*keys, "item").agg(F.sum("cnt").alias("cnt")).join(total, keys), keys, capacity)


def frequent_by(summary: DataFrame, threshold: int = 0, errors: str = NO_FALSE_POSITIVES) -> DataFrame:
    """(keys, item, estimate, lb, ub) of the items of each group whose bound reaches the threshold."""
    at = F.greatest(F.lit(threshold), F.col("offset"))
    low, high = F.col("cnt"), F.col("cnt") + F.col("offset")
    rest = [c for c in summary.columns if c not in ("cnt", "offset")]
    return summary.where((low if errors == NO_FALSE_POSITIVES else high) >= at).select(*rest, high.alias("estimate"), low.alias("lb"), high.alias("ub"))


def top_k(col: Column | str, k: int, capacity: int = 10_000) -> Column:
    """Spark's own aggregate: an array of (item, count)."""
    return F.call_function("approx_top_k", F.col(col) if isinstance(col, str) else col, F.lit(k), F.lit(capacity))


def _cells(df: DataFrame, item: Column, weight: Column, hashes: int, buckets: int, how: str) -> DataFrame:
    cell = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(hash63(F.concat(F.lit(f"{i}:"), item.cast("string")), how), F.lit(buckets)).alias("bucket")) for i in range(hashes)])
    return df.select(F.explode(cell).alias("c"), weight.alias("w")).select("c.row", "c.bucket", "w")


def count_min(df: DataFrame, item: str, relative_error: float = 0.01, confidence: float = 0.99, weight: str | None = None, how: str = "xxhash64") -> DataFrame:
    """(row, bucket, w): at most hashes * buckets rows, added up in each task first."""
    buckets, hashes = countmin_sizes(relative_error, confidence)
    w = F.lit(1).cast("long") if weight is None else F.when(F.col(weight) >= 0, F.col(weight)).otherwise(F.raise_error(F.lit("a weight is negative")))
    # counting items first leaves one row an item, not one an occurrence, for the hashes
    items = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.sum(w).alias("w"))
    return _cells(items, F.col("item"), F.col("w"), hashes, buckets, how).groupBy("row", "bucket").agg(F.sum("w").alias("w"))


def count_min_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "bucket").agg(F.sum("w").alias("w"))


def count_min_estimate(cells: DataFrame, items: DataFrame, item: str, relative_error: float = 0.01, confidence: float = 0.99, how: str = "xxhash64") -> DataFrame:
    """(item, estimate, ub): never below the truth; ub adds the error bound."""
    buckets, hashes = countmin_sizes(relative_error, confidence)
    asked = items.select(F.col(item).alias("item")).where("item is not null").distinct()
    probe = asked.select("item", F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(hash63(F.concat(F.lit(f"{i}:"), F.col("item").cast("string")), how), F.lit(buckets)).alias("bucket")) for i in range(hashes)])).alias("c")).select("item", "c.row", "c.bucket")
    got = probe.join(F.broadcast(cells), ["row", "bucket"], "left").groupBy("item").agg(F.min(F.coalesce("w", F.lit(0))).alias("estimate"))  # hashes * buckets rows at most
    total = cells.where("row = 0").agg(F.sum("w").alias("total"))
    return got.crossJoin(F.broadcast(total)).select("item", "estimate", (F.col("estimate") + F.lit(2.718281828459045 / buckets) * F.coalesce("total", F.lit(0))).alias("ub"))  # one row

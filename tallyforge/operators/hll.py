"""Distinct counts from registers.

Relational form: rows (keys..., slot, v), the greatest value of each register. Merging is the
same maximum again, and registers of different sizes merge by folding slots to the smaller one,
so results do not depend on partitions or on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import address, hash63, hll_bound, hll_estimate, leading_value

MIN_LG_K, MAX_LG_K, DEFAULT_LG_K = 4, 21, 12


def check_lg_k(lg_k: int) -> int:
    if not MIN_LG_K <= lg_k <= MAX_LG_K:
        raise ValueError(f"lg_k must lie between {MIN_LG_K} and {MAX_LG_K}")
    return lg_k


def sketch(col: Column | str, lg_k: int = DEFAULT_LG_K) -> Column:
    return F.hll_sketch_agg(col, check_lg_k(lg_k))


def build(df: DataFrame, col: Column | str, keys: list[str] | None = None, lg_k: int = DEFAULT_LG_K, how: str = "xxhash64") -> DataFrame:
    keys = keys or []
    h = hash63(F.col(col) if isinstance(col, str) else col, how)
    hashed = df.select(*keys, h.alias("h")).where("h is not null")
    return hashed.groupBy(*keys, address(F.col("h"), check_lg_k(lg_k)).alias("slot")).agg(F.max(leading_value(F.col("h"))).alias("v"))


def union(a: DataFrame, lg_a: int, b: DataFrame, lg_b: int, keys: list[str] | None = None) -> tuple[DataFrame, int]:
    """(registers, lg_k) of both, at the smaller size."""
    lg_k = min(check_lg_k(lg_a), check_lg_k(lg_b))
    both = a.unionByName(b).withColumn("slot", F.pmod("slot", F.lit(1 << lg_k)))
    return both.groupBy(*(keys or []), "slot").agg(F.max("v").alias("v")), lg_k


def estimate(s: DataFrame, lg_k: int, keys: list[str] | None = None, kappa: int = 2) -> DataFrame:
    """(keys, filled, estimate, lb, ub)."""
    keys = keys or []
    values = s.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    rows = values.groupBy(*keys).agg(F.collect_list(F.struct("v", "n")).alias("h"), F.sum("n").alias("filled"))
    est = rows.withColumn("estimate", hll_estimate(F.col("h"), lg_k))
    e, f = F.col("estimate"), F.col("filled")
    return est.select(*keys, f, e, hll_bound(e, f, lg_k, kappa, False).alias("lb"), hll_bound(e, f, lg_k, kappa, True).alias("ub"))

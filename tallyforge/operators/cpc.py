"""Distinct counts from (row, column) cells, the densest of the three per bit of state.

Relational form: distinct rows (keys..., row, col). Merging is a distinct union, and different
sizes merge by folding rows to the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import address, cpc_bound, cpc_estimate, hash63, leading_value

MIN_LG_K, MAX_LG_K, DEFAULT_LG_K = 4, 26, 11


def check_lg_k(lg_k: int) -> int:
    if not MIN_LG_K <= lg_k <= MAX_LG_K:
        raise ValueError(f"lg_k must lie between {MIN_LG_K} and {MAX_LG_K}")
    return lg_k


def build(df: DataFrame, col: Column | str, keys: list[str] | None = None, lg_k: int = DEFAULT_LG_K, how: str = "xxhash64") -> DataFrame:
    keys = keys or []
    h = hash63(F.col(col) if isinstance(col, str) else col, how)
    hashed = df.select(*keys, h.alias("h")).where("h is not null")
    return hashed.select(*keys, address(F.col("h"), check_lg_k(lg_k)).alias("row"), (leading_value(F.col("h")) - 1).alias("col")).distinct()


def union(a: DataFrame, lg_a: int, b: DataFrame, lg_b: int) -> tuple[DataFrame, int]:
    lg_k = min(check_lg_k(lg_a), check_lg_k(lg_b))
    return a.unionByName(b).withColumn("row", F.pmod("row", F.lit(1 << lg_k))).distinct(), lg_k


def estimate(s: DataFrame, lg_k: int, keys: list[str] | None = None, kappa: int = 2) -> DataFrame:
    """(keys, coupons, estimate, lb, ub), from the number of cells alone."""
    keys = keys or []
    n = s.groupBy(*keys).agg(F.count("*").alias("coupons")).withColumn("estimate", cpc_estimate(F.col("coupons"), F.lit(lg_k)))
    e, c = F.col("estimate"), F.col("coupons")
    return n.select(*keys, c, e, cpc_bound(e, c, lg_k, kappa, False).alias("lb"), cpc_bound(e, c, lg_k, kappa, True).alias("ub"))

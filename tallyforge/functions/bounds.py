"""Bounds of estimates as columns. They run on a row per estimate, after the aggregation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.hashing import MAX_HASH
from tallyforge.kernels import intervals

__all__ = ["cpc_bound", "cpc_estimate", "hll_bound", "hll_estimate", "proportion_bound", "theta_bound", "theta_estimate"]


def theta_estimate(n: Column, theta: Column) -> Column:
    """n retained hashes below theta, as a DOUBLE."""
    return n.cast("double") / (theta.cast("double") / F.lit(float(MAX_HASH)))


def theta_bound(n: Column, theta: Column, kappa: int, upper: bool) -> Column:
    f = intervals.count_upper if upper else intervals.count_lower

    @F.pandas_udf("double")
    def of(ns: pd.Series, thetas: pd.Series) -> pd.Series:
        return pd.Series([f(int(a), b / MAX_HASH if b < MAX_HASH else 1.0, kappa) for a, b in zip(ns, thetas, strict=True)], dtype=float)

    return of(n.cast("long"), theta.cast("long"))


def proportion_bound(n: Column, k: Column, kappa: Column, upper: bool) -> Column:
    f = intervals.proportion_upper if upper else intervals.proportion_lower

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([f(int(x), int(y), float(z)) for x, y, z in zip(a, b, c, strict=True)], dtype=float)

    return of(n.cast("long"), k.cast("long"), kappa.cast("double"))


def hll_estimate(histogram: Column, lg_k: int) -> Column:
    """histogram: array of (value, registers)."""

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([intervals.hll_estimate({int(x["v"]): int(x["n"]) for x in r}, lg_k) for r in rows], dtype=float)

    return of(histogram)


def hll_bound(estimate: Column, filled: Column, lg_k: int, kappa: int, upper: bool, merged: bool = True) -> Column:
    low = F.greatest(estimate / (1.0 + intervals.hll_error(lg_k, kappa, False, merged)), filled.cast("double"))
    return F.greatest(estimate / (1.0 - intervals.hll_error(lg_k, kappa, True, merged)), estimate) if upper else low


def cpc_estimate(coupons: Column, lg_k: Column) -> Column:
    @F.pandas_udf("double")
    def of(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([intervals.cpc_estimate(int(x), int(y)) for x, y in zip(c, k, strict=True)], dtype=float)

    return of(coupons.cast("long"), lg_k.cast("int"))


def cpc_bound(estimate: Column, coupons: Column, lg_k: int, kappa: int, upper: bool) -> Column:
    e = intervals.cpc_error(lg_k, kappa)
    return F.ceil(estimate / (1.0 - e)).cast("double") if upper else F.greatest(estimate / (1.0 + e), coupons.cast("double"))

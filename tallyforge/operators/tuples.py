"""Distinct keys with a summary each.

Rows (groups..., hash, theta, summaries...), and for each group one row without hash and summaries, which
keeps theta where nothing is retained. A summary is any Spark aggregate when a sketch is built
and another when sketches merge: sums and counts merge by sum, extremes by extremes, arrays
element by element, the last writer by an order column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import MAX_HASH, hash63, theta_bound, theta_estimate
from tallyforge.operators import theta
from tallyforge.operators.bottom import thresholds
from tallyforge.operators.theta import DEFAULT_LG_K, _trim, check_lg_k, lesser_thetas, marked


def build(df: DataFrame, key: Column | str, summary: Mapping[str, Column], groups: list[str] | None = None, lg_k: int = DEFAULT_LG_K, how: str = "xxhash64", few: bool = False) -> DataFrame:
    """A sketch per group. few: the groups are few, as slices are, and their thresholds go to every task."""
    groups = groups or []
    h = hash63(F.col(key) if isinstance(key, str) else key, how)
    k = 1 << check_lg_k(lg_k)
    hashed = df.withColumn("hash", h).where(F.col("hash").isNotNull())
    # the thresholds first, from few rows of each task: only what stays is summarised and moved
    cut = thresholds(hashed.select(*groups, "hash"), groups, k, MAX_HASH)
    held = hashed.crossJoin(F.broadcast(cut)) if not groups else hashed.join(F.broadcast(cut) if few else cut, groups)  # one row
    rows = held.where(F.col("hash") < F.col("theta")).groupBy(*groups, "hash").agg(F.min("theta").alias("theta"), *[c.alias(n) for n, c in summary.items()])
    return marked(rows, cut)


def from_theta(sketch: DataFrame, summary: Mapping[str, Column]) -> DataFrame:
    """A theta sketch with one summary for all its keys."""
    return sketch.select("*", *[F.when(F.col("hash").isNotNull(), c).alias(n) for n, c in summary.items()])


def union(a: DataFrame, b: DataFrame, merge: Mapping[str, Column], groups: list[str] | None = None, lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """merge: an aggregate over the summaries of both sides, for each summary."""
    groups = groups or []
    one = a.unionByName(b).groupBy(*groups, "hash").agg(F.min("theta").alias("theta"), *[c.alias(n) for n, c in merge.items()])
    low = one.withColumn("theta", F.min("theta").over(Window.partitionBy(*groups))).where("hash IS NULL OR hash < theta")
    return _trim(low, groups, 1 << check_lg_k(lg_k))


def intersect(a: DataFrame, b: DataFrame, merge: Mapping[str, Column], groups: list[str] | None = None) -> DataFrame:
    """merge: an expression over a.x and b.x, for each summary x."""
    on = [*(groups or []), "hash"]
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    both = a.alias("a").join(b.alias("b"), cond)
    out = both.select(*[F.col(f"a.{c}").alias(c) for c in on], F.least("a.theta", "b.theta").alias("theta"), *[c.alias(n) for n, c in merge.items()])
    return marked(out.where("hash < theta"), lesser_thetas(a.select(*(groups or []), "hash", "theta"), b.select(*(groups or []), "hash", "theta"), groups or []))


def array_intersect(a: DataFrame, b: DataFrame, col: str, size: int, merge: Column, groups: list[str] | None = None) -> DataFrame:
    """intersect() of sketches whose summary is an array of size numbers; another size on either side is an error.

    merge: an expression over a.x and b.x, x being col.
    """

    def checked(s: DataFrame) -> DataFrame:
        fit = F.col(col).isNull() | (F.size(col) == size)
        return s.withColumn(col, F.when(fit, F.col(col)).otherwise(F.raise_error(F.lit(f"a summary is no array of {size} numbers"))))

    return intersect(checked(a), checked(b), {col: merge}, groups)


def a_not_b(a: DataFrame, b: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Keys of a that are not in b, a tuple or a theta sketch; a's summaries stay."""
    return theta.a_not_b(a, b.select(*(groups or []), "hash", "theta"), groups)


def where(sketch: DataFrame, predicate: Column) -> DataFrame:
    """The keys whose summary fits; theta stays, so estimates are of the fitting keys."""
    return sketch.where(F.col("hash").isNull() | predicate)


def estimate(sketch: DataFrame, groups: list[str] | None = None, sums: tuple[str, ...] = (), kappa: int = 2) -> DataFrame:
    """Distinct keys with bounds, and of each summary named its sum over all keys, seen or not."""
    out = sketch.groupBy(*(groups or [])).agg(F.count("hash").alias("n_retained"), F.coalesce(F.min("theta"), F.lit(MAX_HASH)).alias("theta"), *[F.sum(c).alias(c) for c in sums])
    rate = F.col("theta").cast("double") / F.lit(float(MAX_HASH))
    n, t = F.col("n_retained"), F.col("theta")
    return out.select(*(groups or []), n, t, theta_estimate(n, t).alias("estimate"), theta_bound(n, t, kappa, False).alias("lb"), theta_bound(n, t, kappa, True).alias("ub"), *[(F.col(c) / rate).alias(c) for c in sums])


def b_over_a(a: DataFrame, b: DataFrame) -> tuple[float, float, float]:
    """Bounds of |A and B| / |A| over the keys."""
    return theta.b_over_a(_theta_of(a), _theta_of(b))


def _theta_of(sketch: DataFrame) -> DataFrame:
    return sketch.select("hash", "theta")


def jaccard(a: DataFrame, b: DataFrame) -> tuple[float, float, float]:
    """(lower, estimate, upper) of the similarity of two sketches' keys, whatever their summaries."""
    return theta.jaccard(_theta_of(a), _theta_of(b))


def exactly_equal(a: DataFrame, b: DataFrame) -> bool:
    return theta.exactly_equal(_theta_of(a), _theta_of(b))


def similar(measured: DataFrame, expected: DataFrame, threshold: float) -> bool:
    return jaccard(measured, expected)[0] >= threshold


def dissimilar(measured: DataFrame, expected: DataFrame, threshold: float) -> bool:
    return jaccard(measured, expected)[2] <= threshold


def array_sum(col: str, size: int) -> Column:
    """Element-wise sum of arrays of one size, as a summary or a merge."""
    return F.array(*[F.sum(F.element_at(F.col(col), i + 1)) for i in range(size)])


def strings_key(col: str) -> Column:
    """A key of several strings as one value, in which no two arrays are alike."""
    return F.to_json(F.struct(F.col(col).alias("k")))


def last(col: str, order: str) -> Column:
    """The value of the greatest order: the last writer, wherever rows lie."""
    return F.max_by(F.col(col), F.col(order))

"""Distinct counts with set algebra.

Relational form: rows (keys..., hash, theta), the hashes below theta that a group retains, and
for each group one row without a hash, which keeps theta where nothing is retained. A sketch in exact mode
has theta = MAX_HASH. Nulls are no items; a group without items has no rows, so its estimate
is 0 wherever it is joined in. Without keys there is one group, which always has its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import MAX_HASH, hash63, theta_bound, theta_estimate
from tallyforge.kernels import intervals
from tallyforge.operators.bottom import least_hashes

MIN_LG_K, MAX_LG_K, DEFAULT_LG_K = 5, 26, 12
SLICE = "__slice"


def check_lg_k(lg_k: int) -> int:
    if not MIN_LG_K <= lg_k <= MAX_LG_K:
        raise ValueError(f"lg_k must lie between {MIN_LG_K} and {MAX_LG_K}")
    return lg_k


def sketch(col: Column | str, lg_k: int = DEFAULT_LG_K) -> Column:
    """Spark's own aggregate; whole numbers are taken as longs on every side of a set operation."""
    return F.theta_sketch_agg(F.col(col) if isinstance(col, str) else col, check_lg_k(lg_k))


def slices(rows: int, lg_k: int) -> int:
    """So many slices of key space that half of a sketch's size holds a slice's share of the keys of so many rows."""
    return max(1, -(-rows // (1 << (check_lg_k(lg_k) - 1))))


def sliced(df: DataFrame, col: Column | str, n: int) -> DataFrame:
    """df with the slice of each key: sketches by SLICE count exactly, and counts and set operations add up over slices."""
    return df.withColumn(SLICE, F.pmod(F.xxhash64(F.col(col) if isinstance(col, str) else col), F.lit(n)).cast("int"))


def sliced_sketch(df: DataFrame, col: Column | str, n: int, lg_k: int, name: str) -> DataFrame:
    """(SLICE, name): a sketch for each slice. Keys move before they are sketched, so a task holds the sketches of few slices."""
    key = df.select((F.col(col) if isinstance(col, str) else col).alias("__k")).where("__k IS NOT NULL")
    return sliced(key, "__k", n).repartition(n, SLICE).groupBy(SLICE).agg(sketch("__k", lg_k).alias(name))


def _trim(hashes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k least hashes of each group of distinct (keys, hash, theta) and the new theta."""
    w = Window.partitionBy(*keys)
    placed = hashes.withColumn("place", F.when(F.col("hash").isNotNull(), F.row_number().over(w.orderBy(F.col("hash").asc_nulls_last()))))
    cut = F.least(F.min("theta").over(w), F.coalesce(F.min(F.when(F.col("place") == k + 1, F.col("hash"))).over(w), F.lit(MAX_HASH)))
    return placed.withColumn("theta", cut).where("hash IS NULL OR hash < theta").drop("place")


def marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with a row for each of groups (keys, theta) that has no hash."""
    return rows.unionByName(groups.select("*"), allowMissingColumns=True)


def build(df: DataFrame, col: Column | str, keys: list[str] | None = None, lg_k: int = DEFAULT_LG_K, p: float = 1.0, how: str = "xxhash64") -> DataFrame:
    """A sketch per group of keys. p < 1 samples keys beforehand."""
    if not 0 < p <= 1:
        raise ValueError("p must lie between 0 and 1")
    keys = keys or []
    start = MAX_HASH if p == 1 else int(MAX_HASH * p)
    h = hash63(F.col(col) if isinstance(col, str) else col, how)
    k = 1 << check_lg_k(lg_k)
    every = df.select(*keys, h.alias("hash")).where("hash IS NOT NULL")
    few = least_hashes(every.where(F.col("hash") < start), keys, k).withColumn("theta", F.lit(start).cast("long"))
    if keys and p == 1:
        # a group always retains its least hash, and that row brings the one without a hash
        least = F.col("hash") == F.min("hash").over(Window.partitionBy(*keys))
        both = F.when(least, F.array(F.col("hash"), F.lit(None).cast("long"))).otherwise(F.array("hash"))
        return _trim(few, keys, k).withColumn("__both", both).select(*keys, F.explode("__both").alias("hash"), "theta")
    groups = every.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return _trim(marked(few, groups.withColumn("theta", F.lit(start).cast("long"))), keys, k)


def trim(s: DataFrame, lg_k: int, keys: list[str] | None = None) -> DataFrame:
    """The sketch cut to a smaller nominal size."""
    return _trim(s, keys or [], 1 << check_lg_k(lg_k))


def union(a: DataFrame, b: DataFrame, keys: list[str] | None = None, lg_k: int = DEFAULT_LG_K) -> DataFrame:
    keys = keys or []
    both = a.unionByName(b)
    one = both.groupBy(*keys, "hash").agg(F.min("theta").alias("theta"))
    w = Window.partitionBy(*keys)
    low = one.withColumn("theta", F.min("theta").over(w)).where("hash IS NULL OR hash < theta")
    return _trim(low, keys, 1 << check_lg_k(lg_k))


def intersect(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hashes of both, below the lesser theta, which an intersection without matches keeps as well."""
    keys = keys or []
    theirs = b.where("hash IS NOT NULL").select(*keys, "hash", F.col("theta").alias("__t"))
    both = a.join(theirs, [*keys, "hash"]).withColumn("theta", F.least("theta", "__t")).where("hash < theta").drop("__t")
    return marked(both, lesser_thetas(a, b, keys))


def lesser_thetas(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, theta): of the groups that both have, the lesser theta."""
    mine, theirs = a.where("hash IS NULL").select(*keys, "theta"), b.where("hash IS NULL").select(*keys, F.col("theta").alias("__t"))
    pairs = mine.join(theirs, keys) if keys else mine.crossJoin(F.broadcast(theirs))  # one row
    return pairs.select(*keys, F.least("theta", "__t").alias("theta"))


def a_not_b(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    cut = b.groupBy(*keys).agg(F.min("theta").alias("__t"))
    rest = a.join(b.select(*keys, "hash"), [*keys, "hash"], "left_anti")
    rest = rest.join(cut, keys, "left") if keys else rest.crossJoin(F.broadcast(cut))  # one row
    return rest.withColumn("theta", F.least("theta", F.coalesce("__t", "theta"))).where("hash IS NULL OR hash < theta").drop("__t")


def estimate(s: DataFrame, keys: list[str] | None = None, kappa: tuple[int, ...] = (2,)) -> DataFrame:
    """(keys, n_retained, theta, estimate, lb_k, ub_k) per group."""
    out = s.groupBy(*(keys or [])).agg(F.count("hash").alias("n_retained"), F.coalesce(F.min("theta"), F.lit(MAX_HASH)).alias("theta"))
    out = out.withColumn("estimate", theta_estimate(F.col("n_retained"), F.col("theta")))
    for k in kappa:
        out = out.withColumn(f"lb_{k}", theta_bound(F.col("n_retained"), F.col("theta"), k, False)).withColumn(f"ub_{k}", theta_bound(F.col("n_retained"), F.col("theta"), k, True))
    return out


def estimating_union(a: DataFrame, b: DataFrame) -> tuple[int, int, int, int, int, int]:
    """(retained by a, by b, theta of a, of b, retained by the union, by the intersection), from one plan.

    The union is one that holds all of both, so nothing but the lesser theta cuts it.
    """
    side = lambda s, x, y: s.select("hash", "theta", F.lit(x).alias("in_a"), F.lit(y).alias("in_b"))
    every = side(a, 1, 0).unionByName(side(b, 0, 1))
    one = every.groupBy("hash").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"), F.min(F.when(F.col("in_a") == 1, F.col("theta"))).alias("ta"), F.min(F.when(F.col("in_b") == 1, F.col("theta"))).alias("tb"))
    cut = every.agg(F.coalesce(F.min("theta"), F.lit(MAX_HASH)).alias("cut"))
    below = F.col("hash") < F.col("cut")
    r = one.crossJoin(F.broadcast(cut)).agg(  # one row
        F.count(F.when(F.col("in_a") == 1, F.col("hash"))).alias("na"),
        F.count(F.when(F.col("in_b") == 1, F.col("hash"))).alias("nb"),
        F.coalesce(F.min("ta"), F.lit(MAX_HASH)).alias("ta"),
        F.coalesce(F.min("tb"), F.lit(MAX_HASH)).alias("tb"),
        F.count(F.when(below, F.col("hash"))).alias("nu"),
        F.count(F.when(below & (F.col("in_a") + F.col("in_b") == 2), F.col("hash"))).alias("ni"),
    ).first()
    return tuple(r)


class Comparison:
    """Two sketches without keys, compared in one action: a few numbers leave the cluster."""

    def __init__(self, a: DataFrame, b: DataFrame):
        self.na, self.nb, self.ta, self.tb, self.nu, self.ni = estimating_union(a, b)

    def jaccard(self) -> tuple[float, float, float]:
        """(lower, estimate, upper) of the similarity."""
        empty_a, empty_b = (n == 0 and t == MAX_HASH for n, t in ((self.na, self.ta), (self.nb, self.tb)))
        if empty_a and empty_b:
            return 1.0, 1.0, 1.0
        if empty_a or empty_b:
            return 0.0, 0.0, 0.0
        t = min(self.ta, self.tb)
        return intervals.ratio_bounds(self.nu, self.ni, t / MAX_HASH if t < MAX_HASH else 1.0)

    def equal(self) -> bool:
        return self.na == self.nb == self.ni and self.ta == self.tb

    def similar(self, threshold: float) -> bool:
        """The lower bound of the similarity reaches the threshold (97.7 % sure)."""
        return self.jaccard()[0] >= threshold

    def dissimilar(self, threshold: float) -> bool:
        return self.jaccard()[2] <= threshold


def jaccard(a: DataFrame, b: DataFrame) -> tuple[float, float, float]:
    return Comparison(a, b).jaccard()


def exactly_equal(a: DataFrame, b: DataFrame) -> bool:
    return Comparison(a, b).equal()


def similar(measured: DataFrame, expected: DataFrame, threshold: float) -> bool:
    return Comparison(measured, expected).similar(threshold)


def dissimilar(measured: DataFrame, expected: DataFrame, threshold: float) -> bool:
    return Comparison(measured, expected).dissimilar(threshold)


def b_over_a(a: DataFrame, b: DataFrame) -> tuple[float, float, float]:
    """Bounds of |A and B| / |A|, from what both say below the lesser theta."""
    c = Comparison(a, b)
    f = min(c.ta, c.tb)
    at = a.where(F.col("hash") < f).count() if c.tb < c.ta else c.na
    return intervals.ratio_bounds(at, c.ni, f / MAX_HASH if f < MAX_HASH else 1.0)

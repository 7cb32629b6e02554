"""Operators on small tables: exact mode, merge laws, partitions, odd values."""

import random

import pytest

from pyspark.sql import functions as F
from tallyforge.functions import MAX_HASH, hash63
from tallyforge.operators import cpc, frequency, hll, membership, quantiles, sampling, theta, tuples
from tallyforge.sources import load_sketches, save_sketches, scratch, theta_image


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(k % 3, k % 700, f"w{k % 40}", float(k)) for k in range(3000)] + [(0, None, None, None)], "g int, k long, s string, x double").cache()


def same(a, b):
    rows = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=repr)
    return rows(a) == rows(b)


@pytest.mark.parametrize("build", [lambda d: theta.build(d, "k", lg_k=6), lambda d: theta.build(d, "k", ["g"], 6), lambda d: hll.build(d, "k", ["g"], 8), lambda d: cpc.build(d, "k", lg_k=8), lambda d: frequency.count_min(d, "k"), lambda d: membership.build(d, "k")])
def test_partitions_do_not_matter(items, build):
    assert same(build(items.repartition(1)), build(items.repartition(7)))


def test_theta_modes(items):
    exact = theta.estimate(theta.build(items, "k")).first()
    assert (exact.n_retained, exact.theta, exact.estimate, exact.lb_2, exact.ub_2) == (700, MAX_HASH, 700.0, 700.0, 700.0)
    small = theta.estimate(theta.build(items, "k", lg_k=7), kappa=(3,)).first()
    assert small.n_retained == 128 and small.lb_3 <= 700 <= small.ub_3
    with pytest.raises(ValueError):
        theta.build(items, "k", lg_k=4)


def test_theta_algebra(spark):
    a = theta.build(spark.range(1000), "id", lg_k=14)
    b = theta.build(spark.range(500, 1500), "id", lg_k=14)
    n = lambda s: s.where("hash IS NOT NULL").count()
    assert (n(theta.union(a, b, lg_k=14)), n(theta.intersect(a, b)), n(theta.a_not_b(a, b))) == (1500, 500, 500)
    assert theta.jaccard(a, b) == pytest.approx((1 / 3,) * 3)
    assert theta.exactly_equal(a, theta.build(spark.range(1000).repartition(5), "id", lg_k=14)) and not theta.exactly_equal(a, b)
    assert theta.similar(a, a, 0.9) and theta.dissimilar(a, b, 0.5)
    none = theta.build(spark.range(0), "id")
    assert theta.jaccard(none, none) == (1.0, 1.0, 1.0) and theta.jaccard(a, none) == (0.0, 0.0, 0.0)
    assert theta.estimate(none).first().estimate == 0.0 and n(theta.a_not_b(a, none)) == 1000
    small_a, small_b = (theta.build(spark.range(x, x + 20_000), "id", lg_k=9) for x in (0, 10_000))
    low, _, high = theta.jaccard(small_a, small_b)
    assert low <= 1 / 3 <= high
    assert theta.b_over_a(a, b)[1] == 0.5
    u = theta.estimate(theta.union(small_a, small_b, lg_k=9), kappa=(3,)).first()
    assert u.lb_3 <= 30_000 <= u.ub_3


def test_theta_union_is_commutative_and_idempotent(spark):
    a, b = theta.build(spark.range(5000), "id", lg_k=8), theta.build(spark.range(3000, 9000), "id", lg_k=8)
    assert same(theta.union(a, b, lg_k=8), theta.union(b, a, lg_k=8))
    assert same(theta.union(a, a, lg_k=8), a)
    assert same(theta.union(a, b, lg_k=8), theta.build(spark.range(9000), "id", lg_k=8))


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_native_images_are_read(spark, n):
    data = bytes(spark.range(n).agg(theta.sketch("id", 9).alias("s")).first().s)
    t, hashes = theta_image(data)
    own = [r.hash for r in theta.build(spark.range(n), "id", lg_k=12, how="murmur3").where(F.col("hash") < t).collect()] if n else []
    assert sorted(hashes.tolist()) == sorted(own)


@pytest.mark.parametrize("kind,values", [("double", [0.0, -0.0, 1.5, float("nan")]), ("string", ["a", "bcd", "x" * 40, "é"])])
def test_murmur_of_other_types(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
    t, hashes = theta_image(bytes(df.agg(theta.sketch("v", 9).alias("s")).first().s))
    own = {r.h for r in df.select(hash63(F.col("v"), f"murmur3:{kind}").alias("h")).collect() if r.h is not None}
    assert set(hashes.tolist()) == own


def test_tuples(spark, items):
    build = lambda d: tuples.build(d, "k", {"n": F.count("*"), "most": F.max("x")})
    s = build(items)
    assert tuples.estimate(s, sums=("n",)).first().n == 3000
    a, b = build(items.where("g = 0")), build(items.where("g > 0"))
    u = tuples.union(a, b, {"n": F.sum("n"), "most": F.max("most")})
    assert same(u, s)
    i = tuples.intersect(a, b, {"n": F.col("a.n") + F.col("b.n"), "most": F.greatest("a.most", "b.most")})
    assert i.where('hash IS NOT NULL').count() == 700 and i.agg(F.sum("n")).first()[0] == 3000
    assert tuples.a_not_b(a, theta.build(spark.range(350), "id")).where("hash IS NOT NULL").count() == 350
    assert tuples.where(s, F.col("n") > 4).count() - 1 == s.where("n > 4").count() > 0
    assert tuples.from_theta(theta.build(items, "k"), {"w": F.lit(1)}).agg(F.sum("w")).first()[0] == 700
    small = tuples.estimate(tuples.build(items, "k", {"n": F.count("*")}, lg_k=8), sums=("n",), kappa=3).first()
    assert small.lb <= 700 <= small.ub and small.n == pytest.approx(3000, rel=0.2)


def test_hll_and_cpc(spark, items):
    e = hll.estimate(hll.build(items, "k", lg_k=12), 12, kappa=3).first()
    assert e.lb <= 700 <= e.ub
    a, b = hll.build(spark.range(3000), "id", lg_k=11), hll.build(spark.range(2000, 6000), "id", lg_k=9)
    u, lg = hll.union(a, 11, b, 9)
    assert lg == 9 and same(u, hll.build(spark.range(6000), "id", lg_k=9))
    c, lg = cpc.union(cpc.build(spark.range(3000), "id", lg_k=11), 11, cpc.build(spark.range(2000, 6000), "id", lg_k=9), 9)
    assert same(c, cpc.build(spark.range(6000), "id", lg_k=9))
    e = cpc.estimate(c, 9, kappa=3).first()
    assert e.lb <= 6000 <= e.ub


def test_quantiles(spark, items):
    whole = quantiles.summarise(items, "s", what="kll", k=200).select(quantiles.quantile("sketch", [0.0, 1.0], "kll", "string").alias("q")).first().q
    assert whole == ["w0", "w9"]
    by = quantiles.summarise(items.repartition(6), "x", ["g"], "tdigest").select("g", quantiles.quantile("sketch", [0.5], "tdigest").alias("q"), quantiles.rank("sketch", [1500.0], "tdigest").alias("r"), quantiles.distribution("sketch", [1000.0, 2000.0], "tdigest").alias("c")).collect()
    assert len(by) == 3
    for r in by:
        assert r.q[0] == pytest.approx(1500, rel=0.02) and r.r[0] == pytest.approx(0.5, abs=0.01) and r.c[2] == 1.0
    req = quantiles.summarise(items, "x", what="req").select(quantiles.rank("sketch", [2990.0], "req").alias("r"), quantiles.distribution("sketch", [1500.0], "req", cumulative=False).alias("p")).first()
    assert req.r[0] == pytest.approx(2991 / 3000, abs=1e-9) and sum(req.p) == pytest.approx(1.0)
    none = quantiles.summarise(items.where("x < 0"), "x", ["g"], "kll")
    assert none.collect() == []


def test_kll_columns(items):
    s = items.agg(quantiles.kll("x", 4000).alias("s"))
    r = s.select(quantiles.kll_cdf("s", [999.0, 1999.0]).alias("c"), quantiles.kll_pmf("s", [999.0, 1999.0]).alias("p"), quantiles.kll_boundaries("s", 3).alias("b")).first()
    assert r.c == pytest.approx([1 / 3, 2 / 3, 1.0]) and r.p == pytest.approx([1 / 3] * 3) and r.b == [0.0, 999.0, 1999.0, 2999.0]


def test_frequencies(spark):
    random.seed(2)
    rows = [(f"i{min(int(random.expovariate(0.05)), 400)}", random.randint(0, 5)) for _ in range(4000)]
    df = spark.createDataFrame([*rows, (None, 3)], "item string, w long")
    true = {}
    for i, w in rows:
        true[i] = true.get(i, 0) + w
    halves = [frequency.build(df.where(F.crc32("item") % 2 == p), "item", 16, "w") for p in (0, 1)]
    merged = frequency.merge(*halves, 16)
    held = {r["item"]: r for r in frequency.rows(merged).collect()}
    assert len(held) == 16 and all(r.lb <= true[i] <= r.ub for i, r in held.items())
    assert all(v <= merged[1] for i, v in true.items() if i not in held)
    at = max(merged[1], 100)
    nfp = {r["item"] for r in frequency.frequent(merged, 100).collect()}
    nfn = {r["item"] for r in frequency.frequent(merged, 100, frequency.NO_FALSE_NEGATIVES).collect()}
    assert nfp <= {i for i, v in true.items() if v >= at} and {i for i, v in true.items() if v >= at} <= nfn
    cells = frequency.count_min(df, "item", 0.01, 0.99, "w")
    est = {r["item"]: r for r in frequency.count_min_estimate(cells, df, "item", 0.01, 0.99).collect()}
    assert set(est) == set(true) and all(true[i] <= r.estimate for i, r in est.items())
    with pytest.raises(Exception, match="negative"):
        frequency.build(spark.createDataFrame([("a", -1)], "item string, w long"), "item", 4, "w")[0].collect()


@pytest.mark.parametrize("most", [membership.MOST_BROADCAST_BITS, 0])
def test_bloom(spark, monkeypatch, most):
    monkeypatch.setattr(membership, "MOST_BROADCAST_BITS", most)
    users = spark.range(500).select(F.concat(F.lit("user_"), "id").alias("u"))
    others = spark.range(1000, 1100).select(F.concat(F.lit("user_"), "id").alias("u"))
    bits = membership.build(users, "u", 1000)
    got = membership.probe(users.union(others).union(spark.createDataFrame([(None,)], "u string")), "u", bits, 1000).collect()
    real = {f"user_{k}" for k in range(500)}
    assert len(got) == 601 and all(r.maybe for r in got if r.u in real)
    assert sum(r.maybe for r in got if r.u not in real) <= 9 and not [r for r in got if r.u is None][0].maybe


def test_samples(spark):
    df = spark.range(1000).withColumn("w", (F.col("id") + 1).cast("double"))
    assert sampling.reservoir(df, 10).count() == 10
    by = sampling.reservoir(df.withColumn("g", F.col("id") % 3), 5, ["g"])
    assert sorted(r["count"] for r in by.groupBy("g").count().collect()) == [5, 5, 5]
    h = hash63(F.col("id"))
    parts = [sampling.reservoir(df.where(f"id % 2 = {p}"), 50, order=h) for p in (0, 1)]
    assert same(sampling.reservoir_union(*parts, 50).select("id"), sampling.reservoir(df, 50, order=h).select("id"))
    low, est, high, total = sampling.subset_sum(sampling.reservoir(df, 200, order=h), 1000, F.col("id") < 300)
    assert low <= 300 <= high and total == 1000.0 and low <= est <= high
    s = sampling.varopt(df.repartition(9), "w", 100).cache()
    assert s.count() == 100 and s.agg(F.sum("__weight")).first()[0] == pytest.approx(500500.0)
    low, est, high, _ = sampling.varopt_subset_sum(s, F.col("id") < 500)
    assert low <= est <= high and est == pytest.approx(125250, rel=0.35)
    t = sampling.threshold(df, "w", 100).first()
    assert t.n_rows == 1000 and t.n_heavy == 0 and t.tau == pytest.approx(5005.0)
    assert sampling.threshold(df, "w", 5000).first().tau == 0.0


def test_stored_sketches(spark, items):
    path = scratch(spark, "stored")
    save_sketches(items.groupBy("g").agg(theta.sketch("k").alias("s")), path, "theta", lg_k=12)
    back = load_sketches(spark, path, "theta", lg_k=12)
    assert back.agg(F.theta_sketch_estimate(F.theta_union_agg("s", F.lit(12))).alias("e")).first().e == 700
    with pytest.raises(ValueError):
        load_sketches(spark, path, "theta", lg_k=11)


def test_describe_and_rows(spark, items):
    from tallyforge.operators import describe

    for what in ("kll", "req", "tdigest"):
        s = quantiles.summarise(items, "x", what=what)
        r = s.select(describe.describe("sketch", what).alias("d"), describe.weighted_items("sketch", what).alias("w")).first()
        assert (r.d.n, r.d.low, r.d.high, r.d.estimating) == (3000, "0.0", "2999.0", True) and r.d.retained == len(r.w)
        assert r.w[-1].upto == 3000 and [x.item for x in r.w] == sorted(x.item for x in r.w)
    t = items.agg(theta.sketch("k").alias("s")).select(describe.describe("s", "theta").alias("d"), describe.theta_hashes("s").alias("h")).first()
    assert t.d.retained == len(t.h) == 700 and not t.d.estimating
    own = theta.build(items, "k", lg_k=7, how="murmur3").groupBy("theta").agg(F.collect_list("hash").alias("h"))
    image = own.select("theta", describe.theta_from_rows(F.col("h"), F.col("theta")).alias("s"))
    assert image.select(F.theta_sketch_estimate("s").alias("e")).first().e == round(128 / (own.first().theta / MAX_HASH))


def test_reservoir_union_by_weight(spark):
    a, b = (sampling.reservoir(spark.range(x, y), 100) for x, y in ((0, 9000), (9000, 10_000)))
    u = sampling.reservoir_weighted_union(a, 9000, b, 1000, 100)
    assert u.count() == 100 and 75 <= u.where("id < 9000").count() <= 99


def test_wrappers(spark, items):
    a = tuples.build(items.where("k < 400"), "k", {"n": F.count("*")})
    b = tuples.build(items.where("k >= 200"), "k", {"n": F.count("*")})
    assert tuples.jaccard(a, b) == pytest.approx((200 / 700,) * 3) and tuples.exactly_equal(a, a)
    assert tuples.similar(a, a, 0.9) and tuples.dissimilar(a, b, 0.5)
    w = spark.range(500).withColumn("w", F.lit(2.0))
    u = sampling.varopt_union(sampling.varopt(w, "w", 30), sampling.weighted(sampling.reservoir(w, 20), 500), 25)
    assert u.count() == 25 and u.agg(F.sum("__weight")).first()[0] == pytest.approx(1500.0)
    seen, bits = membership.query_and_update(spark.range(10), "id", membership.build(spark.range(5), "id", 100), 100)
    assert seen.where("maybe").count() >= 5 and same(bits, membership.build(spark.range(10), "id", 100))
    assert membership.compatible((100, 0.01), (100, 0.01)) and not membership.compatible((100, 0.01), (1000, 0.01))
    r = spark.range(1).select(quantiles.rank_bounds(F.lit(0.5), F.lit(10**6)).alias("b")).first().b
    assert r.low < 0.5 < r.high

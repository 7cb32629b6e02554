"""Binary images: round trips, and what other readers make of them."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyforge.kernels.quantile import Kll
from tallyforge.sources import images
from tallyforge.sources.store import theta_image

TOP = (1 << 63) - 1


@pytest.mark.parametrize("theta,hashes", [(TOP, []), (TOP, [5]), (TOP, [9, 5, 7]), (1 << 60, [3, 1 << 59]), (1 << 50, [])])
def test_theta(spark, theta, hashes):
    data = images.theta_to_image(theta, hashes)
    t, h = theta_image(data)
    assert t == theta and h.tolist() == sorted(hashes)
    got = spark.createDataFrame([(bytearray(data),)], "s binary").select(F.theta_sketch_estimate("s").alias("e")).first().e
    assert got == round(len(hashes) / (theta / TOP))


@pytest.mark.parametrize("theta,n", [(TOP, 0), (TOP, 1), (TOP, 5), (1 << 61, 4)])
def test_tuples(theta, n):
    entries = [(7 * k + 1, [float(k), -1.5]) for k in range(n)]
    assert images.tuple_from_image(images.tuple_image(theta, entries, 2), 2) == (theta, entries)
    with pytest.raises(ValueError):
        images.tuple_from_image(images.tuple_image(theta, entries, 2, seed=1), 2)


@pytest.mark.parametrize("kind,items", [("long", [1, -2, 3]), ("double", [0.5, -1.0, 2.0]), ("string", ["a", "", "é€"]), ("long", [])])
def test_item_families(kind, items):
    counts = {x: k + 1 for k, x in enumerate(items)}
    assert images.frequency_from_image(images.frequency_image(counts, 3 if items else 0, 9 if items else 0, 10, kind), kind) == (counts, 3 if items else 0, 9 if items else 0)
    assert images.reservoir_from_image(images.reservoir_image(items, 5, len(items), kind), kind) == (items, 5, len(items))
    heavy = [(x, float(k + 1)) for k, x in enumerate(items)]
    for light in ([], items):
        n = len(heavy) + len(light)
        assert images.varopt_from_image(images.varopt_image(heavy, light, 2.5 if light else 0.0, 8, n, kind), kind) == (heavy, light, 2.5 if light else 0.0, 8, n)


def test_count_min_and_bloom():
    cells = np.arange(12).reshape(3, 4)
    got, total = images.count_min_from_image(images.count_min_image(cells, 22))
    assert (got == cells).all() and total == 22
    assert images.count_min_from_image(images.count_min_image(cells * 0, 0))[0].shape == (3, 4)
    for bits in ([], [0, 5, 63, 64, 127]):
        assert images.bloom_from_image(images.bloom_image(bits, 128, 5)) == (bits, 128, 5, 9001)
    with pytest.raises(ValueError):
        images.bloom_from_image(b"\0" * 40)


@pytest.mark.parametrize("n", [0, 1, 5, 60, 300, 5000])
def test_hll_images_of_spark(spark, n):
    """Spark's image says what Spark says, and its registers in an image of ours give Spark the same estimate as a union."""
    row = spark.range(n).agg(F.hll_sketch_agg("id", 9).alias("s"), F.hll_sketch_estimate(F.hll_sketch_agg("id", 9)).alias("e")).first()
    got = images.hll_from_image(bytes(row.s))
    assert got["lg_k"] == 9 and (got["hip"] is None or round(got["hip"]) == row.e)
    merged = spark.createDataFrame([(bytes(row.s),)] * 2, "s binary").agg(F.hll_union_agg("s").alias("s"))
    want = merged.select(F.hll_sketch_estimate("s")).first()[0]
    for bits in (4, 6, 8):
        data = images.hll_image(got["registers"], bits)
        assert (images.hll_from_image(data)["registers"] == got["registers"]).all()
        e = spark.createDataFrame([(data,)], "s binary").select(F.hll_sketch_estimate("s")).first()[0]
        assert e == want if n > 100 else abs(e - n) <= max(1, 0.05 * n)


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 50_000])
def test_kll_images_of_spark(spark, n):
    data = bytes(spark.range(n).select(F.col("id").cast("double").alias("x")).agg(F.kll_sketch_agg_double("x", F.lit(200)).alias("s")).first().s)
    own = images.kll_from_image(data)
    assert own.n == n
    back = images.kll_image(own)
    if not n:
        return
    ranks = [0.0, 0.01, 0.5, 0.9, 1.0]
    asked = lambda d: spark.createDataFrame([(d,)], "s binary").select(F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(r) for r in ranks])), F.kll_sketch_get_n_double("s")).first()
    assert asked(back) == asked(data) and asked(data)[0] == [own.quantile(r) for r in ranks]
    mine = Kll(100).extend([float(x) for x in range(n)])
    assert abs(asked(images.kll_image(mine))[0][2] - n / 2) <= max(1, 0.05 * n)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 300, 4000])
@pytest.mark.parametrize("theta", [TOP, 1 << 61])
def test_packed_theta_images(spark, n, theta):
    hashes = np.unique(np.random.default_rng(n).integers(1, theta, n))
    data = images.theta_packed_image(theta, hashes)
    got = theta_image(data)
    assert got[0] == theta and got[1].tolist() == hashes.tolist()
    assert n < 9 or len(data) < len(images.theta_to_image(theta, hashes))
    # Spark's functions take it, too
    plain = images.theta_to_image(theta, hashes)
    ask = lambda d: spark.createDataFrame([(d,)], "s binary").select(F.theta_sketch_estimate(F.theta_union("s", "s"))).first()[0]
    assert ask(data) == ask(plain)

"""Numpy kernels against exact answers and known values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.kernels import hashing, intervals, sampling
from tallyforge.kernels.quantile import Kll, Req, SortedView, TDigest


def test_count_bounds_known_values():
    theta = 0.531700444213199
    assert 4342 / theta == pytest.approx(8166.25234614053, abs=1e-9)
    assert intervals.count_lower(4342, theta, 2) == pytest.approx(7996.956955317471, abs=1e-9)
    assert intervals.count_upper(4342, theta, 2) == pytest.approx(8339.090301078124, abs=1e-9)


@given(st.integers(0, 400), st.floats(1e-6, 1.0), st.sampled_from([1, 2, 3]))
@settings(max_examples=150, deadline=None)
def test_count_bounds_hold_the_estimate(n, theta, kappa):
    low, high = intervals.count_lower(n, theta, kappa), intervals.count_upper(n, theta, kappa)
    assert n <= low + 1e-9 or n == 0
    assert low <= n / theta + 1e-6 and high >= n / theta - 1e-6
    if theta >= 1:
        assert low == high == n


def test_small_count_bounds_are_binomial_tails():
    n, theta = 30, 0.1
    low = intervals.count_lower(n, theta, 2)
    tail = lambda N, k: sum(math.comb(N, i) * theta**i * (1 - theta) ** (N - i) for i in range(k, N + 1))
    assert tail(math.floor(low), n) <= intervals.DELTA[2] <= tail(math.ceil(low), n)
    high = intervals.count_upper(n, theta, 2)
    assert 1 - tail(math.ceil(high), n + 1) <= intervals.DELTA[2] <= 1 - tail(math.floor(high), n + 1)


def test_bounds_cover_at_their_rate():
    rng = np.random.default_rng(3)
    for truth, theta in ((1000, 0.05), (20000, 0.02)):
        n = rng.binomial(truth, theta, 400)
        hit = np.mean([intervals.count_lower(int(x), theta, 2) <= truth <= intervals.count_upper(int(x), theta, 2) for x in n])
        assert hit >= 0.93


def test_proportion_special_cases():
    assert intervals.proportion_lower(0, 0, 2) == 0 and intervals.proportion_upper(0, 0, 2) == 1
    assert intervals.proportion_lower(10, 0, 2) == 0 and intervals.proportion_upper(10, 10, 2) == 1
    for k in range(11):
        assert intervals.proportion_lower(10, k, 2) <= k / 10 <= intervals.proportion_upper(10, k, 2)
    assert intervals.ratio_bounds(0, 0, 0.5) == (0.0, 0.5, 1.0)
    assert intervals.ratio_bounds(10, 5, 1.0) == (0.5, 0.5, 0.5)


def test_sizes():
    assert [intervals.countmin_sizes(e, 0.99)[0] for e in (0.2, 0.1, 0.05, 0.01)] == [14, 28, 55, 272]
    assert intervals.bloom_sizes(10_000, 0.01) == (95872, 7)
    assert intervals.frequency_error(128, 1000) == pytest.approx(27.34375)
    with pytest.raises(ValueError):
        intervals.bloom_sizes(0, 0.1)
    assert intervals.kll_rank_error(200) == pytest.approx(0.0133, abs=1e-4) and intervals.kll_rank_error(200, True) == pytest.approx(0.0165, abs=1e-4)


def test_murmur_of_known_strings():
    # the reference vectors of the hash function's author for seed 0
    assert hashing.murmur_bytes(b"", 0) == (0, 0)
    assert hashing.murmur_bytes(b"hello", 0) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert hashing.murmur_bytes(b"The quick brown fox jumps over the lazy dog", 0) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    v = np.array([0, 1, -5, 2**62], np.int64)
    for x, a, b in zip(v, *hashing.murmur_longs(v), strict=True):
        assert hashing.murmur_bytes(int(x).to_bytes(8, "little", signed=True), hashing.SEED) == (int(a), int(b))
    a, _ = hashing.murmur_doubles(np.array([0.0, -0.0, float("nan"), -float("nan")]))
    assert a[0] == a[1] and a[2] == a[3] and 0 < hashing.seed_hash() < 65536


@pytest.mark.parametrize("n", [50, 1000, 30_000, 500_000])
def test_register_and_cell_estimates(n):
    rng = np.random.default_rng(n)
    slot, v = rng.integers(0, 2048, n), rng.geometric(0.5, n)
    reg = np.zeros(2048, int)
    np.maximum.at(reg, slot, v)
    values, counts = np.unique(reg, return_counts=True)
    assert intervals.hll_estimate(dict(zip(values.tolist(), counts.tolist(), strict=True)), 11) == pytest.approx(n, rel=0.08)
    cells = len(np.unique(slot * 64 + np.minimum(v - 1, 63)))
    est = intervals.cpc_estimate(cells, 11)
    low, high = intervals.cpc_bounds(est, cells, 11, 3)
    assert est == pytest.approx(n, rel=0.06) and low <= est <= high


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=100))
@settings(max_examples=80, deadline=None)
def test_small_summaries_are_exact(values):
    s = sorted(values)
    for q in (Kll(200).extend(values), Req(12, seed=3).extend(values) if len(values) < 36 else Kll(200).extend(values)):
        assert q.n == len(s) and q.quantile(0.0) == s[0] and q.quantile(1.0) == s[-1]
        for x in s:
            assert q.rank(x) == sum(y <= x for y in s) / len(s)
            assert q.rank(x, inclusive=False) == sum(y < x for y in s) / len(s)
    t = TDigest(500).extend(values)
    assert t.low == s[0] and t.high == s[-1] and s[0] <= t.quantile(0.5) <= s[-1]


def test_quantile_conventions():
    v = SortedView([10, 20, 30, 40], [1, 1, 1, 1])
    assert [v.quantile(r) for r in (0, 0.25, 0.5, 1)] == [10, 10, 20, 40]
    assert [v.quantile(r, inclusive=False) for r in (0, 0.25, 0.5, 1)] == [10, 20, 30, 40]
    assert v.cdf([15, 35]) == [0.25, 0.75, 1.0] and v.pmf([15, 35]) == [0.25, 0.5, 0.25]
    assert v.boundaries(2) == [10, 20, 40]
    with pytest.raises(ValueError):
        v.cdf([3, 3])


@pytest.mark.parametrize("make", [lambda i: Kll(200, seed=i), lambda i: Req(12, True, i), lambda i: Req(12, False, i), lambda i: TDigest(200)])
def test_error_of_large_and_merged_summaries(make):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=40_000), rng.exponential(size=40_000)])
    rng.shuffle(x)
    parts = [make(i + 1).extend(p.tolist()) for i, p in enumerate(np.array_split(x, 7))]
    merged = type(parts[0]).from_bytes(parts[0].to_bytes())
    for p in parts[1:]:
        merged.merge(type(p).from_bytes(p.to_bytes()))
    assert merged.n == len(x)
    s = np.sort(x)
    for r in (0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999):
        got = np.searchsorted(s, merged.quantile(r), "right") / len(s)
        assert abs(got - r) <= 0.03
        assert abs(merged.rank(float(s[int(r * len(s))])) - r) <= 0.03
    if isinstance(merged, Req):
        ends = (0.999, 0.9999) if merged.high else (0.001, 0.0001)
        for r in ends:
            assert abs(merged.rank(float(s[int(r * len(s))])) - r) <= 1e-3
    empty = make(1)
    assert empty.merge(type(empty).from_bytes(empty.to_bytes())).n == 0


def test_req_refuses_mixed_ends_and_odd_k():
    with pytest.raises(ValueError):
        Req(12).merge(Req(12, high=False))
    with pytest.raises(ValueError):
        Req(13)
    assert Req(12).extend([float("nan"), float("inf"), 1.0]).n == 1
    assert intervals.req_rank_bounds(0.99999, 12, 1_000_000) == (0.99999, 0.99999)


def test_tdigest_singles():
    t = TDigest().extend([1.0, 2.0, 3.0])
    assert [t.quantile(r) for r in (0, 0.2, 0.5, 0.9, 1)] == [1, 1, 2, 3, 3]
    assert t.rank(2.0) == pytest.approx(0.5) and t.rank(0.0) == 0 and t.rank(4.0) == 1
    with pytest.raises(ValueError):
        t.rank(float("nan"))
    assert TDigest.from_bytes(TDigest().to_bytes()).n == 0


def test_kll_strings_and_nulls():
    q = Kll(8).extend(["b", None, "a", ""])
    assert q.n == 3 and q.quantile(0.0) == "" and Kll.from_bytes(q.to_bytes()).quantile(1.0) == "b"


@given(st.lists(st.floats(0.01, 1000), min_size=1, max_size=200), st.integers(1, 30), st.integers(0, 9))
@settings(max_examples=100, deadline=None)
def test_varopt_size_and_total(weights, k, seed):
    w = np.array(weights)
    places, adjusted = sampling.varopt(w, k, np.random.default_rng(seed))
    assert len(places) == min(k, len(w)) == len(set(places.tolist()))
    assert adjusted.sum() == pytest.approx(w.sum(), rel=1e-9)
    tau = sampling.threshold(w, k)
    assert set(np.flatnonzero(w > tau * (1 + 1e-9)).tolist()) <= set(places.tolist()) or tau == 0


def test_varopt_is_unbiased():
    w = np.random.default_rng(1).exponential(size=300) ** 2
    got = []
    for seed in range(600):
        places, adjusted = sampling.varopt(w, 40, np.random.default_rng(seed))
        got.append(adjusted[places % 3 == 0].sum())
    assert np.mean(got) == pytest.approx(w[::3].sum(), rel=0.02)
    random.seed(0)

"""Weighted sampling with a fixed size and adjusted weights."""

from __future__ import annotations

import numpy as np


def threshold(weights: np.ndarray, k: int) -> float:
    """tau with sum(min(1, w / tau)) = k; 0 if there are no more than k weights."""
    if len(weights) <= k:
        return 0.0
    w = np.sort(weights)[::-1]
    rest = np.cumsum(w[::-1])[::-1]
    for h in range(k):
        tau = rest[h] / (k - h)
        if w[h] < tau or np.isclose(w[h], tau, rtol=1e-15, atol=0):
            return float(tau)
    return float(rest[k - 1])


def varopt(weights: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(chosen places, adjusted weights) of k items; heavy ones are certain and keep their weight.

    The light ones are drawn with probability w / tau by pivotal sampling, which always gives
    the same number; each stands for tau. Samples merge by sampling their union again.
    """
    w = np.asarray(weights, np.float64)
    if len(w) <= k:
        return np.arange(len(w)), w
    tau = threshold(w, k)
    heavy = w >= tau
    light = np.flatnonzero(~heavy)
    light = light[rng.permutation(len(light))]
    p = w[light] / tau
    out = list(np.flatnonzero(heavy))
    want = k - len(out)
    # pivotal: two open probabilities meet, one becomes 0 or 1
    chosen, held, q = [], -1, 0.0
    for i, x, u in zip(light.tolist(), p.tolist(), rng.random(len(light)).tolist(), strict=True):
        if held < 0:
            held, q = i, x
            continue
        s = q + x
        if s < 1.0:
            if u >= q / s:
                held = i
            q = s
        else:
            # one of the two is taken, the other goes on with what is left
            first = u < (1.0 - x) / (2.0 - s) if s < 2.0 else True
            chosen.append(held if first else i)
            held, q = (i if first else held), s - 1.0
    if len(chosen) < want and held >= 0:
        chosen.append(held)
    chosen = chosen[:want]
    places = np.array([*out, *chosen], np.int64)
    return places, np.maximum(w[places], tau)

"""Exact hypergeometric draws of any size.

numpy draws up to a thousand million things; beyond, values are drawn by the ratio of
uniforms.  It needs the logarithm of ratios of probabilities near the mode, which are
taken from differences of logarithms of factorials that lose no digits however large the
numbers are.
"""

from __future__ import annotations

import numpy as np

#: What numpy's generator takes.
NUMPY_LIMIT = 1_000_000_000
_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1024)))])


def log_factorial_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(a!) - log(b!) for whole numbers; exact to rounding of the difference where both are large."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    big = np.minimum(a, b) >= len(_SMALL)
    x, y = np.where(big, a, 1024.0), np.where(big, b, 1024.0)
    d = x - y
    tail = lambda n: 1 / (12 * n) - 1 / (360 * n**3)
    large = (y + 0.5) * np.log1p(d / y) + d * np.log(x) - d + tail(x) - tail(y)

    def one(n):
        m = np.maximum(n, 1.0)
        stirling = m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + tail(m)
        return np.where(n < len(_SMALL), _SMALL[np.minimum(n, len(_SMALL) - 1).astype(np.int64)], stirling)

    return np.where(big, large, one(a) - one(b))


def _log_ratio(k, m, good, bad, sample) -> np.ndarray:
    """log of P(k) / P(m)."""
    pairs = ((m, k), (good - m, good - k), (sample - m, sample - k), (bad - sample + m, bad - sample + k))
    return sum(log_factorial_difference(x, y) for x, y in pairs)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: np.ndarray) -> np.ndarray:
    """How many of ``sample`` things, drawn from good and bad ones, are good; one draw for each entry."""
    sample = np.asarray(sample, np.int64)
    total = good + bad
    if total < NUMPY_LIMIT:
        return rng.hypergeometric(good, bad, sample)
    low, high = np.maximum(0, sample - bad), np.minimum(sample, good)
    mode = np.array([(good + 1) * (int(s) + 1) // (total + 2) for s in sample], np.int64)
    mode = np.clip(mode, low, high)
    share = sample / total
    mean, variance = good * share, good * share * (bad / total) * ((total - sample) / max(1, total - 1))
    width = 2 * np.sqrt(2 / np.e) * np.sqrt(variance + 0.5) + 3 - 2 * np.sqrt(3 / np.e)
    out = low.copy()
    todo = np.flatnonzero(high > low)
    while len(todo):
        u, v = 1 - rng.random(len(todo)), rng.random(len(todo))
        k = np.floor(mean[todo] + 0.5 + width[todo] * (v - 0.5) / u)
        fine = (k >= low[todo]) & (k <= high[todo])
        at = np.clip(k, low[todo], high[todo])
        ratio = _log_ratio(at, mode[todo].astype(float), float(good), float(bad), sample[todo].astype(float))
        taken = fine & (2 * np.log(u) <= ratio)
        out[todo[taken]] = at[taken].astype(np.int64)
        todo = todo[~taken]
    return out


def multivariate_hypergeometric(rng: np.random.Generator, counts: np.ndarray, sample: int, size: int) -> np.ndarray:
    """``size`` rows: how many of each kind are among ``sample`` things; kind after kind, each given those before."""
    counts = np.asarray(counts, np.int64)
    if counts.sum() < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(counts, sample, size=size)
    out, left, rest = np.zeros((size, len(counts)), np.int64), np.full(size, sample, np.int64), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        rest -= n
        out[:, k] = hypergeometric(rng, n, rest, left) if rest else left
        left -= out[:, k]
    return out

"""Hypergeometric draws of any size."""

import math

import numpy as np
import pytest

from vecspark.operators import draws


def test_factorials():
    for a, b in ((5, 3), (2000, 1990), (1023, 1024), (3000, 10), (10**6, 10**6 - 7)):
        assert draws.log_factorial_difference(a, b) == pytest.approx(math.lgamma(a + 1) - math.lgamma(b + 1), rel=1e-9)
    n = 10.0**12
    assert draws.log_factorial_difference(n + 2, n) == pytest.approx(math.log(n + 1) + math.log(n + 2), rel=1e-12)


@pytest.mark.parametrize("good,bad,sample", [(30, 50, 20), (3, 4000, 700), (20_000, 30_000, 1000), (5, 3, 7), (0, 9, 4), (9, 0, 4)])
def test_same_distribution_as_numpy(monkeypatch, good, bad, sample):
    rng, n = np.random.default_rng(1), 40_000
    want = np.bincount(rng.hypergeometric(good, bad, sample, n), minlength=sample + 1)
    monkeypatch.setattr(draws, "NUMPY_LIMIT", 0)
    got = np.bincount(draws.hypergeometric(rng, good, bad, np.full(n, sample)), minlength=sample + 1)
    seen = want + got
    chi = (((want - got) ** 2)[seen > 20] / seen[seen > 20]).sum()
    assert chi < (seen > 20).sum() + 6 * math.sqrt(2 * (seen > 20).sum()) + 6


def test_ten_thousand_million_counts():
    rng = np.random.default_rng(2)
    counts, sample = np.array([6 * 10**9, 3 * 10**9, 10**9, 0, 5]), 4 * 10**9
    got = draws.multivariate_hypergeometric(rng, counts, sample, 4000)
    total = counts.sum()
    assert (got.sum(axis=1) == sample).all() and (got <= counts).all() and (got >= 0).all()
    for k in range(3):
        share = counts[k] / total
        mean, sd = sample * share, math.sqrt(sample * share * (1 - share) * (total - sample) / (total - 1))
        assert abs(got[:, k].mean() - mean) < 5 * sd / math.sqrt(4000) and got[:, k].std() == pytest.approx(sd, rel=0.06)
    assert got[:, 4].mean() == pytest.approx(2, abs=0.1)

"""The filter against the plain density of a Gaussian vector, its maximum against a fine grid."""

import math

import numpy as np
import pytest

from granary.operators import statespace


def covariance(n, phi, seasonal, theta):
    """Autocovariances of the process from a long expansion into shocks."""
    psi = np.zeros(4000)
    for t in range(len(psi)):
        psi[t] = (t == 0) + theta * (t == 1) + sum(c * psi[t - k] for k, c in ((1, phi), (4, seasonal), (5, -phi * seasonal)) if t >= k)
    lags = [float(psi[: len(psi) - k] @ psi[k:]) for k in range(n)]
    return np.array([[lags[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("coefficients", [(0.3, -0.2, 0.4), (-0.7, 0.5, -0.6), (0.0, 0.0, 0.0), (0.9, 0.8, 0.5)])
def test_likelihood_is_the_density(coefficients):
    w = np.random.default_rng(2).normal(0, 3, 23)
    c = covariance(len(w), *coefficients)
    quadratic, logdet = w @ np.linalg.solve(c, w), np.linalg.slogdet(c)[1]
    variance = quadratic / len(w)
    want = -0.5 * (len(w) * (math.log(2 * math.pi) + 1 + math.log(variance)) + logdet)
    got, sigma2, *_ = statespace.filtered(w, *coefficients)
    assert got[0] == pytest.approx(want, rel=1e-8) and sigma2[0] == pytest.approx(variance, rel=1e-8)


def test_maximum_against_a_fine_grid():
    rng = np.random.default_rng(4)
    for n in (12, 40):
        w = rng.normal(0, 1, n)
        w[1:] += 0.6 * w[:-1]
        axis = np.linspace(-0.95, 0.95, 20)
        grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
        assert statespace.filtered(w, *statespace.fit(w))[0][0] >= statespace.filtered(w, *grid.T)[0].max() - 1e-6


def test_forecasts():
    """The conditional mean of the differences given all of them, summed up; coefficients are found again."""
    y = np.cumsum(np.random.default_rng(9).normal(1, 2, 40))
    c, coefficients = covariance(38, 0.5, -0.3, 0.2), (0.5, -0.3, 0.2)
    w = statespace.differenced(y)
    ahead = np.array([c[len(w) + h, : len(w)] @ np.linalg.solve(c[: len(w), : len(w)], w) for h in range(3)])
    out = list(y)
    for x in ahead:
        out.append(out[-1] + out[-4] - out[-5] + x)
    assert np.allclose(statespace.forecast(y, 3, coefficients), out[40:])
    assert list(statespace.forecast(np.array([1.0, 5.0]), 3)) == [5.0] * 3 and list(statespace.forecast(np.array([]), 2)) == [0.0] * 2
    assert np.allclose(statespace.forecast(np.arange(30.0), 4), np.arange(30.0, 34.0))
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, 1500)
    x = np.zeros(1500)
    for t in range(1500):
        x[t] = e[t] + 0.4 * e[t - 1] * (t > 0) + 0.6 * x[t - 1] * (t > 0) - 0.5 * x[t - 4] * (t > 3) + 0.3 * x[t - 5] * (t > 4)
    assert np.allclose(statespace.fit(x), (0.6, -0.5, 0.4), atol=0.08)

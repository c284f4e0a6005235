"""Seasonal ARIMA (1,1,1)(1,1,0,4) by exact maximum likelihood in state-space form.

The differenced series w follows (1 - phi B)(1 - seasonal B^4) w = (1 + theta B) e. Its
state has five parts, the first of them w itself; a Kalman filter that begins in the
stationary distribution gives the likelihood, with the variance of e concentrated out.
Filters of many coefficients run side by side as arrays, and the maximum is searched on
a grid and from its best points on; one product's series, a row a calendar
week at most, is all that a task holds.
"""

from __future__ import annotations

import math

import numpy as np

ORDER = 5
#: Greatest absolute coefficient: inside it the series is stationary and invertible.
EDGE = 0.98
#: Least variance, for series without any.
TINY = 1e-9


def differenced(y: np.ndarray) -> np.ndarray:
    """First differences, less those four steps before."""
    d = np.diff(np.asarray(y, float))
    return d[4:] - d[:-4]


def _system(phi: np.ndarray, seasonal: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrices and covariances of the noise."""
    n = len(phi)
    move = np.zeros((n, ORDER, ORDER))
    move[:, 0, 0], move[:, 3, 0], move[:, 4, 0] = phi, seasonal, -phi * seasonal
    move[:, np.arange(ORDER - 1), np.arange(1, ORDER)] = 1.0
    shock = np.zeros((n, ORDER))
    shock[:, 0], shock[:, 1] = 1.0, theta
    return move, shock[:, :, None] * shock[:, None, :]


def filtered(w: np.ndarray, phi, seasonal, theta) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, variance of e, state after the last value, transition) for each of the coefficients."""
    phi, seasonal, theta = (np.atleast_1d(np.asarray(x, float)) for x in (phi, seasonal, theta))
    move, noise = _system(phi, seasonal, theta)
    n = len(phi)
    # The stationary covariance: P = T P T' + Q, as linear equations.
    both = np.einsum("nij,nkl->nikjl", move, move).reshape(n, ORDER**2, ORDER**2)
    p = np.linalg.solve(np.eye(ORDER**2) - both, noise.reshape(n, -1, 1)).reshape(n, ORDER, ORDER)
    a, squares, logs = np.zeros((n, ORDER)), np.zeros(n), np.zeros(n)
    turned = move.transpose(0, 2, 1)
    for value in w:
        error, f = value - a[:, 0], p[:, 0, 0]
        squares += error**2 / f
        logs += np.log(f)
        gain = p[:, :, 0] / f[:, None]
        a = np.einsum("nij,nj->ni", move, a + gain * error[:, None])
        p = move @ (p - gain[:, :, None] * p[:, :1, :]) @ turned + noise
    t = max(1, len(w))
    variance = np.maximum(squares / t, TINY)
    return -0.5 * (t * (math.log(2 * math.pi) + 1 + np.log(variance)) + logs), variance, a, move


def fit(w: np.ndarray, starts: int = 8) -> tuple[float, float, float]:
    """Coefficients (phi, seasonal, theta) of the greatest likelihood: the best points of a
    coarse grid are moved to the best of their neighbours, ever closer ones, side by side."""
    grid = np.stack(np.meshgrid(*[np.linspace(-EDGE, EDGE, 11)] * 3, indexing="ij"), -1).reshape(-1, 3)
    points = grid[np.argsort(-filtered(w, *grid.T)[0], kind="stable")[:starts]]
    around = np.stack(np.meshgrid(*[[0.0, -1.0, 1.0]] * 3, indexing="ij"), -1).reshape(-1, 3)
    width = 0.15
    while width > 1e-4:
        near = np.clip(points[:, None, :] + width * around, -EDGE, EDGE)
        found = filtered(w, *near.reshape(-1, 3).T)[0].reshape(len(points), -1)
        points = near[np.arange(len(points)), found.argmax(1)]
        width *= 0.65
    return tuple(map(float, points[filtered(w, *points.T)[0].argmax()]))


def forecast(y: np.ndarray, steps: int, coefficients: tuple[float, float, float] | None = None) -> np.ndarray:
    """The next values of a series, by fitted or given coefficients. Series too short to difference go on with their last value."""
    y = np.asarray(y, float)
    if len(y) < 7:
        return np.full(steps, y[-1] if len(y) else 0.0)
    w = differenced(y)
    _, _, a, move = filtered(w, *(coefficients or fit(w)))
    state, out = a[0], list(y)
    for _ in range(steps):
        out.append(out[-1] + out[-4] - out[-5] + state[0])
        state = move[0] @ state
    return np.array(out[len(y) :])

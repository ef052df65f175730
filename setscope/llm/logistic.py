"""Logistic regression on sparse rows, and its calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(offsets: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, dim: int,
        rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole weighted log loss with an L2 penalty."""
    w, b = np.zeros(dim), 0.0
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=value * w[index], minlength=len(y)) + b
        g = weight * (sigmoid(z) - y)
        grad = np.append(np.bincount(index, weights=value * g[row], minlength=dim) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) is the probability of label 1 (Platt's targets, Newton steps).

    Without both labels there is nothing to fit and z stays as it is.
    """
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack((z, np.ones(len(z))))
    centre, spread = z.mean(), z.std() + 1e-9
    x[:, 0] = (z - centre) / spread
    ab = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ ab)
        grad = x.T @ (weight * (p - target)) + 1e-3 * np.array([ab[0], 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(ab[0] / spread), float(ab[1] - ab[0] * centre / spread)

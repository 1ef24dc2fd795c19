"""Small linear models on sparse rows, fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of a sparse matrix: row k has values[ends[k-1]:ends[k]] at columns there."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.cols], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=self.values * r[self.rows], minlength=self.shape[1])

    def taken(self, rows: np.ndarray) -> Sparse:
        """The rows of a boolean mask."""
        number, keep = np.cumsum(rows) - 1, rows[self.rows]
        return Sparse(number[self.rows[keep]], self.cols[keep], self.values[keep], (int(rows.sum()), self.shape[1]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, ridge: float, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, weights of the dense extra columns, intercept) of a ridge logistic regression on labels from 0 to 1, by accelerated gradient steps. A sample of one class gives a constant."""
    n = len(y)
    y = np.clip(y, 1e-3, 1 - 1e-3) if n else y
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return np.zeros(x.shape[1]), np.zeros(extra.shape[1]), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    w, b = np.zeros(x.shape[1] + extra.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    d = x.shape[1]
    # A quarter of the largest eigenvalue of the mean of x x' (power iteration) bounds the curvature.
    v, size = np.ones(d + extra.shape[1]), 1.0
    for _ in range(12):
        z = x.dot(v[:d]) + extra @ v[d:]
        v = np.concatenate((x.back(z), extra.T @ z)) / n
        size = np.linalg.norm(v)
        v /= size or 1.0
    rate = 1 / (0.3 * size + 0.3 + ridge)
    look, look_b, momentum = w.copy(), b, 1.0
    for _ in range(steps):
        r = sigmoid(x.dot(look[:d]) + extra @ look[d:] + look_b) - y
        after = look - rate * (np.concatenate((x.back(r), extra.T @ r)) / n + ridge * look)
        after_b = look_b - rate * r.mean()
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, look_b = after + (momentum - 1) / grown * (after - w), after_b + (momentum - 1) / grown * (after_b - b)
        w, b, momentum = after, after_b, grown
    return w[:d], w[d:], float(b)

"""Small trained models, fitted on the driver from bounded samples of feature rows."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """L2 logistic regression on standardised features, by Newton steps. One class or no rows: a constant."""

    def __init__(self, l2: float = 1.0) -> None:
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        n, d = x.shape
        self.mean, self.sd = (x.mean(axis=0), x.std(axis=0) + 1e-9) if n else (np.zeros(d), np.ones(d))
        weight = np.ones(n) if weight is None else weight
        z = np.c_[np.ones(n), (x - self.mean) / self.sd]
        self.w = np.zeros(d + 1)
        rate = (weight @ y + 0.5) / (weight.sum() + 1.0) if n else 0.5
        self.w[0] = np.log(rate / (1 - rate))
        if n and 0 < y.sum() < n:
            ridge = np.full(d + 1, self.l2)
            ridge[0] = 1e-6
            for _ in range(25):
                p = sigmoid(z @ self.w)
                step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * self.w)
                self.w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
                if np.abs(step).max() < 1e-6:
                    break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.sd] @ self.w


def bit_models(x: np.ndarray, targets: np.ndarray, weight: np.ndarray, l2: float = 1e-5, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights (features + 1, bits) of binary logistic models trained together by Adam; targets are -1 and 1, row weights sum to 1."""
    weight = weight.astype(x.dtype)[:, None]
    z = np.c_[x, np.ones(len(x), x.dtype)]
    w = np.zeros((z.shape[1], targets.shape[1]), x.dtype)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -z.T @ (weight * targets * sigmoid(-targets * (z @ w))).astype(x.dtype) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1.0, 10 / t + 0.1)
    return w

"""Small numeric helpers of the classifiers: sigmoid, FTRL-proximal and a ridge logistic fit."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Logistic regression by follow-the-regularised-leader (proximal), one row at a time."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.z = np.zeros(size)
        self.n = np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """``index`` holds no value twice."""
        w = self.weights(index)
        g = (sigmoid(float(w @ value)) - label) * value
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] = n + g * g


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and a last intercept by Newton steps on standardised columns, given back unscaled."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        hess = z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] / scale) @ mean]

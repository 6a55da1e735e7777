"""Logistic regression by follow-the-regularised-leader (FTRL-proximal) on hashed sparse features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; `z` and `n` are the accumulated state."""

    size: int
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights_at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example: distinct coordinates i with values x, label y in [0, 1]."""
        w = self.weights_at(i)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def weights(self) -> np.ndarray:
        return self.weights_at(np.arange(self.size)).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

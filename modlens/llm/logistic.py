"""A small logistic model, fitted on a bounded sample and carried to tasks as numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, importance: np.ndarray | None = None, ridge: float = 0.05) -> Logistic:
    """Newton's method on standardised columns."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    importance = np.ones(len(x)) if importance is None else importance
    weights = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(weights))
    penalty[-1, -1] = 1e-9
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -50, 50)))
        slope = z.T @ (importance * (p - y)) + penalty @ weights
        curve = (z * (importance * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(weights)), slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(centre, scale, weights)

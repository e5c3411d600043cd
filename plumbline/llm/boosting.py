"""Gradient-boosted trees for two classes in numpy, with a calibrated output."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Sum of regression trees on the logistic loss. A tree is arrays (feature, threshold, value) in heap order; a row
    goes left where its feature is at most the threshold; feature -1 marks a leaf."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.25
    least: int = 12
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
        raw = np.zeros(len(x))
        for _ in range(self.rounds):
            p = _sigmoid(raw)
            tree = self._grow(x, y - p, p * (1 - p), cuts)
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _grow(self, x, gradient, weight, cuts):
        nodes = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        rows = {0: np.arange(len(x))}
        for k in range(nodes):
            if k not in rows:
                continue
            own = rows[k]
            g, h = gradient[own], weight[own]
            value[k] = self.rate * g.sum() / (h.sum() + 1.0)
            if 2 * k + 2 >= nodes or len(own) < 2 * self.least:
                continue
            best, before = 1e-6, g.sum() ** 2 / (h.sum() + 1.0)
            for j, at in enumerate(cuts):
                left = x[own, j][:, None] <= at[None, :]
                n, gl, hl = left.sum(axis=0), g @ left, h @ left
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - before
                gain[(n < self.least) | (len(own) - n < self.least)] = 0
                if gain.max() > best:
                    best, feature[k], threshold[k] = gain.max(), j, at[gain.argmax()]
            if feature[k] >= 0:
                left = x[own, feature[k]] <= threshold[k]
                rows[2 * k + 1], rows[2 * k + 2] = own[left], own[~left]
        return feature, threshold, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt's scaling on rows that fit() has not seen, by Newton steps."""
        z, w = self.raw(x), np.zeros(2)
        a = np.stack([z, np.ones(len(z))], axis=1)
        for _ in range(30):
            p = _sigmoid(a @ w)
            w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        self.scale, self.shift = w
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.raw(x) + self.shift)


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest threshold of at least 0.5 from which on the kept rows have this precision; above 1 if there is none."""
    for t in np.unique(np.concatenate([[0.5], p[p > 0.5]])):
        if (kept := p >= t).any() and y[kept].mean() >= precision:
            return float(t)
    return 1.1

"""Gradient-boosted trees for small, bounded training sets: logistic loss, histogram splits, sigmoid calibration."""

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays: inner node i of a tree splits on feature[i] <= cut[i] and has children 2i+1 and 2i+2."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    penalty: float = 1.0
    bias: float = 0.0
    trees: list = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias, self.trees = float(np.log(p / (1 - p))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 32))) for c in x.T]
        bins = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)])  # x <= c[k] where the bin is k at most
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(x, bins, q - y, q * (1 - q), cuts)
            self.trees.append(tree)
            f += self._leaf(tree, x)
        return self

    def _grow(self, x, bins, g, h, cuts):
        inner = (1 << self.depth) - 1
        feature, cut, value = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(2 * inner + 1)
        at = np.zeros(len(g), np.int32)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows):
                a, b = g[rows], h[rows]
                whole = a.sum() ** 2 / (b.sum() + self.penalty)
                for j, c in enumerate(cuts):
                    at_bin = bins[j, rows]
                    ga, ha = (np.bincount(at_bin, w, len(c) + 1).cumsum()[:-1] for w in (a, b))
                    gain = ga**2 / (ha + self.penalty) + (a.sum() - ga) ** 2 / (b.sum() - ha + self.penalty) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, c[k]
                at[rows] = np.where(x[rows, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
        for leaf in range(inner, 2 * inner + 1):
            rows = at == leaf
            value[leaf] = -self.rate * g[rows].sum() / (h[rows].sum() + self.penalty)
        return feature, cut, value

    def _leaf(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), np.int32)
        for _ in range(self.depth):
            at = np.where(x[np.arange(len(x)), feature[at]] <= cut[at], 2 * at + 1, 2 * at + 2)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Fits probability = sigmoid(slope * margin + offset) on rows that the trees haven't seen (Newton steps)."""
        m = self.margin(x)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        w, z = np.array([1.0, 0.0]), np.stack([m, np.ones(len(m))], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - t))
            w -= step
            if abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(w[0]), float(w[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset))) if len(x) else np.zeros(0)

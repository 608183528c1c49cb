"""Gradient-boosted trees in numpy: logistic loss, binned features, Newton steps, scaled to probabilities on rows of their own."""

from __future__ import annotations

import numpy as np


class Boosted:
    """margin = start + sum of trees; probability = sigmoid(scale * margin + shift)."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.start, self.scale, self.shift = 0.0, 1.0, 0.0
        #: Per tree and inner node, in rows from the root: feature and the value that the left side doesn't exceed; then the leaves.
        self.features = np.zeros((0, 0), np.int64)
        self.cuts = np.zeros((0, 0))
        self.leaves = np.zeros((0, 0))

    def _edges(self, x: np.ndarray) -> list[np.ndarray]:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        return [np.unique(np.quantile(x[:, f], q, method="lower")) for f in range(x.shape[1])]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        edges = self._edges(x)
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: above edge b - 1, at most edge b
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin, inner = np.full(n, self.start), (1 << self.depth) - 1
        self.features, self.cuts, self.leaves = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf), np.zeros((self.trees, inner + 1))
        slot = binned + np.arange(width) * self.bins
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                goes = np.zeros(len(rows), bool)
                if len(rows) >= 2 * self.least:
                    at = slot[rows].ravel()
                    sums = [np.bincount(at, np.repeat(w[rows], width), width * self.bins).reshape(width, self.bins).cumsum(1) for w in (g, h, np.ones(n))]
                    left, all_ = [s[:, :-1] for s in sums], [s[0, -1] for s in sums]
                    right = [a - s for a, s in zip(all_, left, strict=True)]
                    gain = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - all_[0] ** 2 / (all_[1] + self.ridge)
                    gain = np.where((left[2] >= self.least) & (right[2] >= self.least), gain, 0)
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-9:
                        self.features[t, k], self.cuts[t, k] = f, edges[f][b]
                        goes = binned[rows, f] > b
                node[rows] = 2 * k + 1 + goes
            leaf = node - inner
            top, below = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.leaves[t] = -self.rate * top / (below + self.ridge)
            margin += self.leaves[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, every = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Boosted:
        """Fits scale and shift by Newton's method on rows that the trees haven't seen, with labels drawn in a little, so that separable rows don't run away."""
        m = self.margin(x)
        good, bad = float(y.sum()), float(len(y) - y.sum())
        want = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + b)))
            d, w = p - want, p * (1 - p) + 1e-9
            matrix = np.array([[w @ (m * m), w @ m], [w @ m, w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(matrix, [d @ m, d.sum()])
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))

"""Gradient-boosted regression trees on quantile-binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Least-squares boosting with trees of fixed depth; prediction is vectorised over rows."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.1, least: float = 8.0, ridge: float = 1.0, share: float = 0.35, seed: int = 1):
        """Each tree sees a random ``share`` of the features (at least three)."""
        self.trees, self.depth, self.rate, self.least, self.ridge, self.share, self.seed = trees, depth, rate, least, ridge, share, seed

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        """Fit to the rows of ``x``; constant features and few rows are fine."""
        n, f = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(f)]
        b = self._bin(x)
        m = min(f, max(3, round(f * self.share)))
        draw = np.random.default_rng(self.seed)
        self.base = float(np.average(y, weights=w))
        g = y - self.base
        self.feature = np.zeros((self.trees, (1 << self.depth) - 1), np.int32)
        self.cut = np.full((self.trees, (1 << self.depth) - 1), BINS, np.int32)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        for t in range(self.trees):
            node = np.zeros(n, np.int64)
            seen = np.sort(draw.choice(f, m, replace=False))
            cell = b[:, seen] + np.arange(m) * BINS
            gw, ww = np.repeat(g * w, m), np.repeat(w, m)
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * (m * BINS) + cell).ravel()
                s = np.bincount(at, weights=gw, minlength=k * m * BINS).reshape(k, m, BINS)
                c = np.bincount(at, weights=ww, minlength=k * m * BINS).reshape(k, m, BINS)
                sl, cl = s.cumsum(axis=2), c.cumsum(axis=2)
                st, ct = sl[:, :, -1:], cl[:, :, -1:]
                gain = sl**2 / (cl + self.ridge) + (st - sl) ** 2 / (ct - cl + self.ridge) - st**2 / (ct + self.ridge)
                gain[(cl < self.least) | (ct - cl < self.least)] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                ok = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
                self.feature[t, k - 1 : 2 * k - 1] = np.where(ok, seen[best // BINS], 0)
                self.cut[t, k - 1 : 2 * k - 1] = np.where(ok, best % BINS, BINS)
                own = k - 1 + node
                node = 2 * node + (b[np.arange(n), self.feature[t, own]] > self.cut[t, own])
            leaves = 1 << self.depth
            self.leaf[t] = self.rate * np.bincount(node, weights=g * w, minlength=leaves) / (np.bincount(node, weights=w, minlength=leaves) + self.ridge)
            g = g - self.leaf[t, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x``."""
        n = len(x)
        b, i = self._bin(x) if n else np.zeros((0, len(self.edges)), np.int64), np.arange(n)
        out = np.full(n, self.base)
        for t in range(self.trees):
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                own = (1 << level) - 1 + node
                node = 2 * node + (b[i, self.feature[t, own]] > self.cut[t, own])
            out += self.leaf[t, node]
        return out

"""Multi-label logistic regression over dense features and hashed n-grams, in numpy."""

from __future__ import annotations

import numpy as np

BITS = 15
#: F1 that a threshold nearer to even odds may cost.
SLACK = 0.003
_SHIFT = np.uint64(64 - BITS)


def slots(h: np.ndarray) -> np.ndarray:
    """Weight slot of each n-gram hash."""
    return (h >> _SHIFT).astype(np.int64)


class Linear:
    """One logistic regression a label; examples are dense rows plus lists of n-gram slots."""

    def __init__(self, labels: int, dense: int):
        self.dense = np.zeros((dense, labels))
        self.hashed = np.zeros((1 << BITS, labels), np.float32)
        self.bias = np.zeros(labels)
        self.cut = np.zeros(labels)

    def scores(self, x: np.ndarray, slot: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Logits of each example and label; an example's n-grams are averaged by a square root."""
        n = len(x)
        out = np.einsum("ij,jk->ik", x, self.dense) + self.bias  # no BLAS: its threads would fight over a worker's core
        size = np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(row, weights=self.hashed[slot, k], minlength=n) / size
        return out

    def fit(self, x: np.ndarray, slot: np.ndarray, row: np.ndarray, y: np.ndarray, *, steps: int = 600, batch: int = 256, rate: float = 0.1, ridge: float = 1e-5, seed: int = 5) -> Linear:
        """Adam on the log loss of small batches; a quarter of the examples is held out for the cuts."""
        held = np.random.default_rng(seed).random(len(x)) < 0.25
        keep = ~held[row]
        self._descend(x[~held], slot[keep], (np.cumsum(~held) - 1)[row[keep]], y[~held], steps, batch, rate, ridge, seed)
        s = self.scores(x, slot, row)[held]
        self.cut = np.array([best_cut(s[:, k], y[held, k]) for k in range(y.shape[1])])
        self.held_out = [f1(s[:, k] > self.cut[k], y[held, k]) for k in range(y.shape[1])]
        return self

    def _descend(self, x, slot, row, y, steps, batch, rate, ridge, seed) -> None:
        n, labels = len(x), y.shape[1]
        if not n:
            return
        by = np.argsort(row, kind="stable")
        slot, row = slot[by], row[by]
        first = np.searchsorted(row, np.arange(n + 1))
        size = np.sqrt(np.maximum(np.diff(first), 1))
        used, slim = np.unique(slot, return_inverse=True)
        params = [np.zeros((x.shape[1], labels)), np.zeros((len(used), labels)), np.zeros(labels)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, t = np.random.default_rng(seed), 0
        while t < steps:
            order = rng.permutation(n)
            for a in range(0, n, batch)[: steps - t]:
                i = order[a : a + batch]
                t += 1
                many = first[i + 1] - first[i]
                own = np.repeat(np.arange(len(i)), many)
                k = slim[np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[i], many)]
                s = np.einsum("ij,jk->ik", x[i], params[0]) + params[2]
                for c in range(labels):
                    s[:, c] += np.bincount(own, weights=params[1][k, c], minlength=len(i)) / size[i]
                e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[i]) / len(i)
                per = e / size[i][:, None]
                g = np.stack([np.bincount(k, weights=per[own, c], minlength=len(used)) for c in range(labels)], axis=1)
                step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
                for j, grad in enumerate((np.einsum("ij,ik->jk", x[i], e) + ridge * params[0], g + 30 * ridge * params[1], e.sum(axis=0))):
                    m[j] += 0.1 * (grad - m[j])
                    v[j] += 0.01 * (grad**2 - v[j])
                    params[j] -= step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
        self.dense, self.bias = params[0], params[2]
        self.hashed[used] = params[1]


def f1(said: np.ndarray, truth: np.ndarray) -> float:
    """Harmonic mean of precision and recall."""
    hit = float((said & (truth > 0)).sum())
    return 2 * hit / max(1.0, said.sum() + truth.sum())


def best_cut(score: np.ndarray, truth: np.ndarray) -> float:
    """A threshold with the best F1, or less by at most ``SLACK``: of these the one nearest to even odds; in the middle of the gap it lies in.

    A few odd examples then do not move the threshold far.
    """
    order = np.argsort(-score)
    s, t = score[order], truth[order] > 0
    if not t.any():
        return np.inf
    hit = np.cumsum(t)
    f = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    f[:-1][s[:-1] == s[1:]] = -1
    middle = (s + np.append(s[1:], s[-1] - 4)) / 2
    good = np.flatnonzero(f >= f.max() - SLACK)
    return float(middle[good[np.argmin(np.abs(middle[good]))]])

"""Small gradient-boosted trees for binary labels, in numpy, with calibrated output."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_BINS = 32
#: Scores beyond this count as this; keeps the calibration finite on separable labels.
_LIMIT = 12.0


@dataclass
class Boosted:
    """Trees of a fixed depth on logistic loss; ``scale`` and ``shift`` calibrate the score (Platt)."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    penalty: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, _BINS + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, f = b.shape
        nodes = (1 << self.depth) - 1
        feature, cut, value = np.zeros(nodes, int), np.full(nodes, _BINS), np.zeros(1 << self.depth)
        at = np.zeros(n, int)
        flat = b + np.arange(f) * _BINS
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if len(mine):
                idx = flat[mine].ravel()
                gs = np.bincount(idx, np.repeat(g[mine], f), f * _BINS).reshape(f, _BINS).cumsum(axis=1)
                hs = np.bincount(idx, np.repeat(h[mine], f), f * _BINS).reshape(f, _BINS).cumsum(axis=1)
                gt, ht = g[mine].sum(), h[mine].sum()
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                best = int(np.argmax(gain))
                if gain.ravel()[best] > 1e-9:
                    feature[node], cut[node] = divmod(best, _BINS)
                at[mine] = 2 * node + 1 + (b[mine, feature[node]] > cut[node])
        for leaf in range(1 << self.depth):
            mine = at == leaf + nodes
            value[leaf] = self.rate * g[mine].sum() / (h[mine].sum() + self.penalty)
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit scale, shift and the threshold of best F1 on rows held out from ``fit``."""
        s = np.clip(self._score(x), -_LIMIT, _LIMIT)
        a, c = 1.0, 0.0
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + c)))
            w = p * (1 - p) + 1e-9
            hess = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            pull = np.array([((goal - p) * s).sum() - (a - 1), (goal - p).sum() - c])
            step = np.clip(np.linalg.solve(hess + np.eye(2), pull), -0.5, 0.5)
            a, c = a + step[0], c + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(c)
        p = self.predict(x)
        cuts = np.linspace(0.05, 0.95, 19)
        f1 = [2 * (hit := (y[p >= t]).sum()) / max(1, (p >= t).sum() + y.sum()) for t in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        self.threshold = float(cuts[best[len(best) // 2]])
        return self

    def _score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._leaf(t, b) for t in self.trees), np.zeros(len(b)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * np.clip(self._score(x), -_LIMIT, _LIMIT) + self.shift)))

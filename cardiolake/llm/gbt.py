"""Small gradient-boosted trees for binary labels, on quantile bins, in NumPy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, second-order gains, level-wise trees of fixed depth stored as arrays."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 4.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)])
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        score, self.feature, self.cut, self.leaf = np.full(len(y), self.base), [], [], []
        inner = 2**self.depth - 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = 1e-6
                if len(rows) > 1:
                    gs, hs = g[rows], h[rows]
                    for f in range(x.shape[1]):
                        if not len(cuts[f]):
                            continue
                        b = binned[f, rows]
                        gl = np.cumsum(np.bincount(b, gs, self.n_bins))[:-1]
                        hl = np.cumsum(np.bincount(b, hs, self.n_bins))[:-1]
                        gr, hr = gs.sum() - gl, hs.sum() - hl
                        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gs.sum() ** 2 / (hs.sum() + self.ridge)
                        gain[(hl < self.least / 4) | (hr < self.least / 4)] = 0
                        gain = gain[: len(cuts[f])]
                        i = int(gain.argmax())
                        if gain[i] > best:
                            best, feature[node], cut[node] = gain[i], f, cuts[f][i]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            leaf = at - inner
            value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
            score += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = 2**self.depth - 1
        for feature, cut, value in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out

    def to_dict(self) -> dict:
        """What ``score`` needs, for JSON; a cut of None sends every row to the left."""
        cuts = [[float(x) if np.isfinite(x) else None for x in c] for c in self.cut]
        return {"depth": self.depth, "base": self.base, "feature": [f.tolist() for f in self.feature], "cut": cuts, "leaf": [v.tolist() for v in self.leaf]}

    @classmethod
    def from_dict(cls, kept: dict) -> BoostedTrees:
        trees = cls(trees=len(kept["leaf"]), depth=kept["depth"])
        trees.base = kept["base"]
        trees.feature = [np.asarray(f, dtype=np.int64) for f in kept["feature"]]
        trees.cut = [np.asarray([np.inf if x is None else x for x in c]) for c in kept["cut"]]
        trees.leaf = [np.asarray(v) for v in kept["leaf"]]
        return trees

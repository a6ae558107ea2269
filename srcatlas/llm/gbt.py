"""Gradient-boosted trees over binned features, small enough to be fitted on
a bounded sample in one process and applied to whole batches of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Log-odds as a sum of complete binary trees of one depth."""

    depth: int
    bias: float
    feature: np.ndarray         # tree x inner node
    threshold: np.ndarray       # go right where the value is above
    value: np.ndarray           # tree x leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(f))]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.2,
        bins: int = 32, least: float = 8.0, ridge: float = 1.0, columns: float = 0.5, seed: int = 7) -> BoostedTrees:
    """Logistic boosting with Newton leaves and histogram splits; each tree
    sees a share of the features, so that no single one carries the model."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    rng = np.random.default_rng(seed)
    share = float((weight * y).sum() / weight.sum())
    bias = float(np.log(share / (1 - share)))
    score = np.full(n, bias)
    inner = 2 ** depth - 1
    model = BoostedTrees(depth, bias, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        used = rng.choice(m, max(1, int(columns * m)), replace=False)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = at - first
            best = np.full(width, 1e-6)
            which, cut = np.zeros(width, np.int64), np.full(width, np.inf)
            for j in used:
                key = local * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins)
                hs = np.bincount(key, h, width * bins).reshape(width, bins)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl ** 2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga ** 2 / (ha + ridge)
                gain[(hl < least / 8) | (ha - hl < least / 8)] = 0
                gain = gain[:, :len(cuts[j])]
                if not gain.shape[1]:
                    continue
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better], which[better], cut[better] = top[better], j, cuts[j][b[better]]
            model.feature[k, first:first + width], model.threshold[k, first:first + width] = which, cut
            at = 2 * at + 1 + (x[np.arange(n), which[local]] > cut[local])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        model.value[k] = rate * gs / (hs + ridge)
        score += model.value[k][leaf]
    return model

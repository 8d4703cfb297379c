"""Small gradient-boosted trees for two classes, over whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import sigmoid


@dataclass
class BoostedTrees:
    """cuts: bin edges by feature; trees: (feature, bin) by node and value by leaf, each tree full to its depth; base: log odds."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right").astype(np.uint8) for k, c in enumerate(self.cuts)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self.binned(x)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range((len(feature) + 1).bit_length() - 1):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 5.0, share: float = 0.5) -> BoostedTrees:
    """Newton boosting of the logistic loss; splits by histograms, the first of equally good ones wins. Each tree sees a share of the features."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = BoostedTrees(cuts, [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    b = model.binned(x).astype(np.int64)
    width = max(len(c) for c in cuts) + 1
    score = np.full(len(y), model.base)
    told, rng = [k for k in range(x.shape[1]) if len(cuts[k]) > 1 or (x[:, k] != x[0, k]).any()], np.random.default_rng(0)
    for _ in range(trees):
        seen = np.sort(rng.permutation(told)[: max(1, int(share * len(told)))])
        p = sigmoid(score)
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255, dtype=np.int64)
        for level in range(depth):
            n, first = 2**level, 2**level - 1
            best = np.full(n, 1e-6)
            for k in seen:
                key = (at - first) * width + b[:, k]
                gs = np.bincount(key, weights=g, minlength=n * width).reshape(n, width).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=n * width).reshape(n, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least * 0.05) | (ht - hs < least * 0.05)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(n), top]
                better = value > best
                best[better] = value[better]
                feature[first : first + n][better] = k
                cut[first : first + n][better] = top[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + ridge)
        score += value[leaf]
        model.trees.append((feature, cut, value))
    return model

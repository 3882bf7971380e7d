"""Gradient-boosted regression trees with logistic loss in numpy, on quantile-binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees as arrays: feature, threshold, children and leaf value by node."""

    bias: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            out += value[at]
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Second-order boosting: each split maximises the gain of the binned gradient sums."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, left, right, value = [], [], [], [], []

        def grow(rows: np.ndarray, level: int) -> int:
            node = len(feature)
            for a in (feature, threshold, left, right):
                a.append(-1)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value.append(rate * total_g / (total_h + ridge))
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                for j in range(x.shape[1]):
                    code = codes[rows, j]
                    n = np.cumsum(np.bincount(code, minlength=BINS + 1))[:-1]
                    sg = np.cumsum(np.bincount(code, g[rows], BINS + 1))[:-1]
                    sh = np.cumsum(np.bincount(code, h[rows], BINS + 1))[:-1]
                    gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                    gain[(n < least) | (len(rows) - n < least)] = 0
                    k = int(gain[: len(cuts[j])].argmax()) if len(cuts[j]) else 0
                    if len(cuts[j]) and gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                _, j, k = best
                feature[node], threshold[node] = j, cuts[j][k]
                goes = codes[rows, j] <= k
                left[node] = grow(rows[goes], level + 1)
                right[node] = grow(rows[~goes], level + 1)
            return node

        grow(np.arange(len(y)), 0)
        tree = (np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value))
        model.trees.append(tree)
        margin += Boosted(0.0, [tree]).margin(x)
    return model

"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays; ``left`` is the row of the left child, the right one follows it.

    A leaf points to itself, so that every row can take the same number of
    steps.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[node] != node
                right = (x[rows, self.feature[node]] > self.threshold[node]) & inner
                node = self.left[node] + right
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least_rows: int = 10
) -> Forest:
    """Boost ``trees`` trees on the logistic loss; ``y`` lies between 0 and 1.

    Without rows, or with one class only, the forest is its base value.
    """
    if len(x) == 0:
        return Forest(*(np.zeros(0, t) for t in (np.int64, float, np.int64, float, np.int64)), depth, 0.0)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    feature, threshold, left, value, roots = [], [], [], [], []
    margin = np.full(len(x), base)

    def new_node() -> int:
        feature.append(0), threshold.append(0.0), left.append(len(left)), value.append(0.0)
        return len(left) - 1

    for _ in range(trees if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(new_node())
        level = {roots[-1]: np.arange(len(x))}
        for step in range(depth + 1):
            below = {}
            for node, rows in level.items():
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = -rate * g / (h + ridge)
                best = _best_split(binned[rows], grad[rows], hess[rows], cuts, bins, ridge, least_rows) if step < depth else None
                if best is None:
                    margin[rows] += value[node]
                    continue
                f, at = best
                feature[node], threshold[node] = f, cuts[f][at]
                left[node] = new_node()
                new_node()
                goes_right = binned[rows, f] > at
                below[left[node]], below[left[node] + 1] = rows[~goes_right], rows[goes_right]
            level = below
    return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(value, float), np.array(roots, int), depth, base)


def _best_split(binned, grad, hess, cuts, bins, ridge, least_rows):
    """(feature, cut) of the largest gain, or None."""
    best, found = 1e-6, None
    g, h, n = grad.sum(), hess.sum(), len(grad)
    whole = g * g / (h + ridge)
    for f, c in enumerate(cuts):
        if len(c) == 0:
            continue
        gl = np.cumsum(np.bincount(binned[:, f], grad, bins + 1))[: len(c)]
        hl = np.cumsum(np.bincount(binned[:, f], hess, bins + 1))[: len(c)]
        nl = np.cumsum(np.bincount(binned[:, f], minlength=bins + 1))[: len(c)]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - whole
        gain[(nl < least_rows) | (n - nl < least_rows)] = -1
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (f, at)
    return found

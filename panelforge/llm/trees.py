"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays.

Trees grow best leaf first on histograms of the features. A split that would break a constraint is not taken, and the
values of both sides are held on their side of the middle of the two for all later splits, so that the sum of the trees
is monotonic in each constrained feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """All trees in one set of node arrays. A leaf's children are the leaf itself, so that every walk has the same length."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray, block: int = 1 << 12) -> np.ndarray:
        """Log odds of every row of ``x``: all rows step down all trees together."""
        out = np.empty(len(x))
        for start in range(0, len(x), block):
            rows = x[start : start + block]
            at = np.repeat(self.roots[None, :], len(rows), axis=0)
            for _ in range(self.depth):
                goes = np.take_along_axis(rows, self.feature[at], axis=1) <= self.threshold[at]
                at = np.where(goes, self.left[at], self.right[at])
            out[start : start + block] = self.base + self.value[at].sum(axis=1)
        return out


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the borders between bins: middles between neighbouring distinct values, at most ``bins - 1``."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def best_split(grad, hess, counts, lows, signs, least: int, ridge: float, bounds: tuple[float, float]):
    """The split ``(gain, feature, bin, left value, right value)`` of a node, from its histograms ``(feature, bin)``.

    ``signs`` holds +1 where the score must not fall with the feature, -1 where it must not rise, 0 where it is free.
    """
    g, h, n = (np.cumsum(a, axis=1)[:, :-1] for a in (grad, hess, counts))
    total_g, total_h, total_n = grad[0].sum(), hess[0].sum(), counts[0].sum()
    values = [np.clip(-a / (b + ridge), *bounds) for a, b in ((g, h), (total_g - g, total_h - h))]
    own = np.clip(-total_g / (total_h + ridge), *bounds)

    def loss(a, b, v):
        return a * v + 0.5 * (b + ridge) * v * v

    gain = loss(total_g, total_h, own) - loss(g, h, values[0]) - loss(total_g - g, total_h - h, values[1])
    legal = (n >= least) & (total_n - n >= least) & (signs[:, None] * (values[1] - values[0]) >= 0) & lows
    gain = np.where(legal, gain, -np.inf)
    feature, place = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, place]), int(feature), int(place), float(values[0][feature, place]), float(values[1][feature, place])


def train(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, leaves: int = 8, rate: float = 0.2, least: int = 10, ridge: float = 1.0
) -> Forest:
    """Logistic loss by second-order boosting. The same rows in any order give the same forest."""
    signs = np.asarray(signs)
    ones = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(ones / (1 - ones)))
    cuts = edges(x)
    width = max(2, max(len(c) for c in cuts) + 1)
    lows = np.arange(width - 1)[None, :] < np.array([len(c) for c in cuts])[:, None]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    order = np.lexsort((y, *binned.T))
    x, y, binned = x[order], y[order], binned[order]
    flat = binned + np.arange(x.shape[1]) * width
    odds = np.full(len(y), base)
    feature, threshold, left, right, value, roots, deepest = [], [], [], [], [], [], 0

    def add(v: float) -> int:
        node = len(value)
        for a, b in ((feature, 0), (threshold, np.inf), (left, node), (right, node), (value, v)):
            a.append(b)
        return node

    def histograms(rows: np.ndarray):
        places = flat[rows].ravel()
        size = x.shape[1] * width
        weights = (grad[rows], hess[rows], np.ones(len(rows)))
        return [np.bincount(places, np.repeat(w, x.shape[1]), size).reshape(-1, width) for w in weights]

    def opened(node: int, rows: np.ndarray, bounds: tuple[float, float], depth: int):
        return (best_split(*histograms(rows), lows, signs, least, ridge, bounds), node, rows, bounds, depth)

    for _ in range(trees if len(y) else 0):
        chance = 1 / (1 + np.exp(-odds))
        grad, hess = chance - y, chance * (1 - chance)
        everyone = np.arange(len(y))
        root = add(float(-grad.sum() / (hess.sum() + ridge)))
        roots.append(root)
        front = [opened(root, everyone, (-np.inf, np.inf), 0)]
        for _ in range(leaves - 1):
            best = max(range(len(front)), key=lambda i: front[i][0][0])
            (gain, f, place, low, high), node, rows, bounds, depth = front[best]
            if not gain > 1e-9:
                break
            front.pop(best)
            goes = binned[rows, f] <= place
            feature[node], threshold[node] = f, float(cuts[f][place])
            left[node], right[node] = add(low), add(high)
            middle = (low + high) / 2
            below, above = bounds, bounds
            if signs[f] > 0:
                below, above = (bounds[0], middle), (middle, bounds[1])
            elif signs[f] < 0:
                below, above = (middle, bounds[1]), (bounds[0], middle)
            front.append(opened(left[node], rows[goes], below, depth + 1))
            front.append(opened(right[node], rows[~goes], above, depth + 1))
            deepest = max(deepest, depth + 1)
        for _, node, rows, _, _ in front:
            value[node] *= rate
            odds[rows] += value[node]
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64, np.int32)
    arrays = [np.array(a, dtype=t) for a, t in zip((feature, threshold, left, right, value, roots), kinds)]
    return Forest(*arrays, depth=deepest, base=base)

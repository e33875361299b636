"""Gradient-boosted trees for small tables of candidates, and a precision threshold."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Binary classifier: logistic loss, second-order gains, trees of bounded depth over binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    ridge: float = 1.0
    bins: int = 24
    base: float = 0.0
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, p - y, p * (1 - p), cuts)
            self.trees.append(tree)
            margin += self._leaves(tree, x)
        return self

    def _grow(self, x, gradient, curvature, cuts) -> list[tuple[int, float, float]]:
        """A complete tree as a heap of (feature, cut, value); feature -1 is a leaf."""
        tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            g, h = gradient[rows].sum(), curvature[rows].sum()
            best = (1e-6, -1, 0.0)
            if 2 * at + 2 < len(tree) and len(rows) > 8:
                for feature, values in enumerate(cuts):
                    if not len(values):
                        continue
                    place = np.searchsorted(values, x[rows, feature], side="left")
                    gl = np.cumsum(np.bincount(place, gradient[rows], len(values) + 1))[:-1]
                    hl = np.cumsum(np.bincount(place, curvature[rows], len(values) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                    if gain.max() > best[0]:
                        best = (gain.max(), feature, float(values[gain.argmax()]))
            _, feature, cut = best
            tree[at] = (feature, cut, float(-self.rate * g / (h + self.ridge)))
            if feature >= 0:
                right = x[rows, feature] > cut
                todo += [(2 * at + 1, rows[~right]), (2 * at + 2, rows[right])]
        return tree

    @staticmethod
    def _leaves(tree, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            feature, cut, value = tree[at]
            if feature < 0:
                out[rows] = value
            elif len(rows):
                right = x[rows, feature] > cut
                todo += [(2 * at + 1, rows[~right]), (2 * at + 2, rows[right])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._leaves(tree, x)
        return 1 / (1 + np.exp(-margin))


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest cut at and above which held-out rows have the precision wanted; above 1 if there is none."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_tie = np.r_[probability[order][1:] != probability[order][:-1], True] if len(y) else np.array([], bool)
    good = np.flatnonzero((right >= precision) & last_of_tie)
    return float(probability[order][good[-1]]) if len(good) else 2.0

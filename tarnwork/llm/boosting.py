"""Small gradient boosted trees with logistic loss: fitted in numpy, applied as a Spark column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    bias: float
    #: each a leaf (float) or (feature, border, tree where feature <= border, tree where above)
    trees: list
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            d, border, low, high = tree
            out, below = np.empty(len(rows)), rows[:, d] <= border
            out[below], out[~below] = walk(low, rows[below]), walk(high, rows[~below])
            return out

        return self.bias + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability as nested conditions over the features."""

        def build(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            d, border, low, high = tree
            return F.when(features[d] <= F.lit(float(border)), build(low)).otherwise(build(high))

        total = F.lit(float(self.bias))
        for tree in self.trees:
            total = total + build(tree)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, l2: float):
    leaf = float(-g.sum() / (h.sum() + l2))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, whole = None, g.sum() ** 2 / (h.sum() + l2)
    for d in range(x.shape[1]):
        order = np.argsort(x[:, d], kind="stable")
        v, gs, hs = x[order, d], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if not len(cut):
            continue
        gain = gs[cut] ** 2 / (hs[cut] + l2) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + l2) - whole
        i = int(gain.argmax())
        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
            best = (float(gain[i]), d, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best is None:
        return leaf
    _, d, border = best
    low = x[:, d] <= border
    return (d, border, _grow(x[low], g[low], h[low], depth - 1, least, l2), _grow(x[~low], g[~low], h[~low], depth - 1, least, l2))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8, l2: float = 1.0) -> Trees:
    """Boosts on four fifths of the rows and calibrates slope and shift (Platt) on the rest."""
    rest = np.arange(len(y)) % 5 == 4
    xt, yt = x[~rest], y[~rest]
    p = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))), [])
    score = np.full(len(yt), model.bias)

    def scaled(tree):
        return tree * rate if not isinstance(tree, tuple) else (tree[0], tree[1], scaled(tree[2]), scaled(tree[3]))

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = scaled(_grow(xt, q - yt, q * (1 - q), depth, least, l2))
        model.trees.append(tree)
        score += Trees(0.0, [tree]).raw(xt)
    raw, target = model.raw(x[rest]), y[rest]
    # Smoothed targets keep the slope finite where the rest is told apart without error.
    target = np.where(target == 1, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * raw + b)))
        w = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((q - target) * raw).sum(), (q - target).sum()])
        hessian = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(a), float(b)
    return model

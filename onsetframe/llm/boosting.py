"""Small gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays.

Fitted on a bounded sample of labelled rows on the driver; scored in tasks, a whole batch at a
time: every row steps down all levels of a tree by indexing the node arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node ``i`` of tree ``t``: rows with ``x[feature] <= cut`` go to ``2i + 1``, others to ``2i + 2``."""

    feature: np.ndarray  # (trees, nodes) int
    cut: np.ndarray  # (trees, nodes) float; +inf where a branch stops early
    value: np.ndarray  # (trees, nodes) float, used in the last level
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 40, depth: int = 3, rate: float = 0.3,
    bins: int = 64, penalty: float = 1.0, least: int = 10,
) -> Trees | None:
    """Logistic boosting on binned features; None unless both classes occur.

    ``monotone`` gives the sign in which the score may depend on a feature. A split that breaks
    it is not taken, and each side's values are held on their side of the middle of the split.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    coded = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    prior = y.mean()
    base = float(np.log(prior / (1 - prior)))
    nodes = 2 ** (depth + 1) - 1
    model = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), depth, base)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        rows = {0: (np.arange(len(y)), -np.inf, np.inf)}
        for node in range(2**depth - 1):
            members, low, high = rows.get(node, (np.empty(0, np.int64), -np.inf, np.inf))
            split = _best_split(coded, cuts, gradient, weight, members, monotone, low, high, bins, penalty, least)
            left, right = 2 * node + 1, 2 * node + 2
            if split is None:  # everything goes left
                rows[left], rows[right] = (members, low, high), (members[:0], low, high)
                continue
            f, code, middle = split
            model.feature[t, node], model.cut[t, node] = f, cuts[f][code]
            goes_left = coded[members, f] <= code
            sign = monotone.get(f, 0)
            rows[left] = (members[goes_left], middle if sign < 0 else low, middle if sign > 0 else high)
            rows[right] = (members[~goes_left], middle if sign > 0 else low, middle if sign < 0 else high)
        for node in range(2**depth - 1, nodes):
            members, low, high = rows[node]
            if len(members):
                step = np.clip(gradient[members].sum() / (weight[members].sum() + penalty), low, high)
                model.value[t, node] = rate * step
                margin[members] += rate * step
    return model


def _best_split(coded, cuts, gradient, weight, members, monotone, low, high, bins, penalty, least):
    """Feature, bin and middle value of the best allowed split, or None."""
    if len(members) < 2 * least:
        return None
    best, found = 1e-9, None
    g, w = gradient[members], weight[members]
    for f in range(coded.shape[1]):
        codes = coded[members, f]
        count = np.bincount(codes, minlength=bins)[: len(cuts[f])].cumsum()
        gl = np.bincount(codes, g, minlength=bins)[: len(cuts[f])].cumsum()
        wl = np.bincount(codes, w, minlength=bins)[: len(cuts[f])].cumsum()
        gr, wr = g.sum() - gl, w.sum() - wl
        left, right = np.clip(gl / (wl + penalty), low, high), np.clip(gr / (wr + penalty), low, high)
        gain = gl**2 / (wl + penalty) + gr**2 / (wr + penalty) - g.sum() ** 2 / (w.sum() + penalty)
        allowed = (count >= least) & (len(members) - count >= least)
        if monotone.get(f, 0):
            allowed &= monotone[f] * (right - left) >= 0
        gain = np.where(allowed, gain, 0)
        if len(gain) and gain.max() > best:
            best, code = gain.max(), int(gain.argmax())
            found = (f, code, float(left[code] + right[code]) / 2)
    return found

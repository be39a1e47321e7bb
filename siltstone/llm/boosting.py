"""Gradient-boosted trees for binary labels, on histograms, with calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth; a row goes right where its value exceeds the cut."""

    depth: int
    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base, np.float64)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Fit by second-order boosting of the logistic loss."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int64)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(prior / (1 - prior))))
    score = np.full(n, model.base)
    inner, ends = 2**depth - 1, 2**depth
    features, thresholds, leaves = [], [], []
    offset = np.arange(m) * BINS
    for _ in range(trees):
        p = _sigmoid(score)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f_of, c_of = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        b_of = np.full(inner, BINS, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * BINS) + offset + binned).ravel()
            size = width * m * BINS
            hist = lambda w: np.bincount(at, np.repeat(w, m), size).reshape(width, m, BINS)
            gs, hs = hist(g).cumsum(axis=2), hist(h).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < 1e-2) | (ha - hs < 1e-2)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    f_of[first + k], c_of[first + k], b_of[first + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), f_of[node]] > b_of[node])
        end = node - inner
        value = -rate * np.bincount(end, g, ends) / (np.bincount(end, h, ends) + ridge)
        score += value[end]
        features.append(f_of), thresholds.append(c_of), leaves.append(value.astype(np.float32))
    model.feature, model.cut, model.leaf = np.array(features), np.array(thresholds), np.array(leaves)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> None:
    """Fit the sigmoid of the probabilities on held-out rows, and the threshold of best F1, of equals the one nearest a half."""
    z, t = model.raw(x), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = ((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    model.scale, model.shift = float(max(a, 0.1)), float(b)
    p = model.probability(x)
    marks = np.linspace(0.1, 0.9, 33)
    f1 = [2 * (y * (p >= m)).sum() / max(1, (p >= m).sum() + y.sum()) for m in marks]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    model.threshold = float(marks[best[np.abs(marks[best] - 0.5).argmin()]])


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, more_x: np.ndarray, more_y: np.ndarray, more_fold: np.ndarray, **how: float) -> Trees | None:
    """Trees fit on all rows but those with ``fold`` 0, which calibrate them.

    ``more``: further rows to learn from but not to calibrate by, such as copies
    with some features hidden. None if either part lacks one of the two labels.
    """
    x, more_x, y = x.astype(np.float32), more_x.astype(np.float32), y.astype(np.float64)
    held, more = fold == 0, more_fold != 0
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return None
    model = grow(np.concatenate([x[~held], more_x[more]]), np.concatenate([y[~held], more_y[more]]), **how)
    calibrate(model, x[held], y[held])
    return model

"""Gradient boosted trees for binary targets on small dense tables, with a calibrated output. Plain numpy."""

from __future__ import annotations

import numpy as np

BINS = 16


def _tree(x: np.ndarray, bins: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    """A nested (feature, cut, below, above) or a leaf value, by second-order gain."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-3, None, 0.0)
    if depth:
        for f, cuts in enumerate(bins):
            for c in cuts:
                low = x[rows, f] <= c
                gl, hl = g[rows][low].sum(), h[rows][low].sum()
                gr, hr = total_g - gl, total_h - hl
                if min(hl, hr) >= 0.5:
                    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - total_g * total_g / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, f, c)
    if best[1] is None:
        return float(-rate * total_g / (total_h + 1))
    low = x[rows, best[1]] <= best[2]
    return best[1], float(best[2]), _tree(x, bins, g, h, rows[low], depth - 1, rate), _tree(x, bins, g, h, rows[~low], depth - 1, rate)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    out, low = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[low], out[~low] = _apply(tree[2], x[low]), _apply(tree[3], x[~low])
    return out


class Boosted:
    """Trees, a Platt scale and a decision threshold."""

    def __init__(self):
        self.trees, self.scale, self.shift, self.threshold = [], 1.0, 0.0, 0.5
        self.precision = self.recall = float("nan")  # at the threshold, on the held-out rows

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None, rounds: int = 40, depth: int = 3, rate: float = 0.3, precision: float = 0.95) -> Boosted:
        """The held rows (every third without any) calibrate: a logistic fit of the raw score, and of the thresholds from which on that precision holds the highest with the most recall."""
        held = np.arange(len(y)) % 3 == 2 if held is None else held
        tx, ty = x[~held], y[~held].astype(float)
        bins = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        score = np.zeros(len(ty))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _tree(tx, bins, p - ty, p * (1 - p), np.arange(len(ty)), depth, rate)
            self.trees.append(tree)
            score += _apply(tree, tx)
        r, cy = self.raw(x[held]), y[held].astype(float)
        design, w = np.stack([r, np.ones(len(r))], 1), np.array([1.0, 0.0])
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            w += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (cy - p) - 0.1 * (w - [1, 0]))
        self.scale, self.shift = map(float, w)
        p = self.probability(x[held])
        self.threshold, best = 0.95, -1.0
        for t in np.linspace(0.95, 0.05, 19):
            if not (p >= t).any() or cy[p >= t].mean() < precision:
                break
            if (found := (p >= t)[cy > 0].mean()) > best:
                self.threshold, best = float(t), found
        chosen = p >= self.threshold
        self.precision, self.recall = float(cy[chosen].mean()) if chosen.any() else float("nan"), float(chosen[cy > 0].mean())
        return self

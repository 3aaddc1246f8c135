"""Gradient-boosted trees and isotonic calibration in numpy, for models of bounded size on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Tree:
    """Complete binary tree: feature and threshold of the inner nodes, values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.leaf).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return self.leaf[at - len(self.feature)]


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> Tree:
    inner = (1 << depth) - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(len(codes), dtype=np.int64)
    for level in range(depth):
        first, width = (1 << level) - 1, 1 << level
        best = np.zeros(width)
        for f in range(codes.shape[1]):
            if not len(cuts[f]):
                continue
            key = (node - first) * BINS + codes[:, f]
            gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
            hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
            all_g, all_h = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + ridge) + (all_g - gs) ** 2 / (all_h - hs + ridge) - all_g**2 / (all_h + ridge)
            gain[(hs < least) | (all_h - hs < least)] = 0
            gain = gain[:, : len(cuts[f])]
            at = gain.argmax(axis=1)
            value = gain[np.arange(width), at]
            better = value > best + 1e-9
            best[better] = value[better]
            feature[first : first + width][better] = f
            threshold[first : first + width][better] = cuts[f][at[better]]
        # Code k holds values up to cuts[k]; comparing codes with the cut's place is the same as comparing values.
        place = np.array([np.searchsorted(cuts[f], t) if np.isfinite(t) else BINS for f, t in zip(feature, threshold, strict=True)])
        node = 2 * node + 1 + (codes[np.arange(len(codes)), feature[node]] > place[node])
    leaf = node - inner
    gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
    return Tree(feature, threshold, gs / (hs + ridge))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Logistic loss, second-order steps, histogram splits."""
    cuts = []
    for f in range(x.shape[1]):
        levels = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(levels[levels < x[:, f].max()] if len(x) else levels)
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    margin = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(codes, cuts, y - p, p * (1 - p), depth, ridge, least)
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising step line from margin to probability."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, last margin
    for m, v in zip(margin[order], y[order], strict=True):
        if blocks and blocks[-1][2] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, last, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][2] = last
    xs = [x for b in blocks for x in (b[3], b[2])]
    # Shrunk towards one half a little, so that no knot says never or always.
    ps = [(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in range(2)]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


def calibrated(knots: tuple[np.ndarray, np.ndarray], margin: np.ndarray) -> np.ndarray:
    xs, ps = knots
    return np.interp(margin, xs, ps) if len(xs) else np.full(len(margin), 0.5)

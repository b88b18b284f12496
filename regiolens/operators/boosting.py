"""Second-order gradient boosting of regression trees in NumPy.

One call fits one series (or one shard of pooled rows) from start to end inside
a task, so a fit costs no Spark job per round.

Algorithm: Chen, Guestrin, "XGBoost: A Scalable Tree Boosting System", KDD 2016.
For squared loss the gradient is ``prediction - y`` and the hessian 1; a leaf's
value is ``-G / (H + l2)``, a split's gain ``GL^2 / (HL + l2) + GR^2 / (HR + l2)
- G^2 / (H + l2)``.  Features are cut into at most ``max_bins`` bins once; trees
grow level by level, all nodes of a level in one histogram; the next level's
smaller problem is the rows of nodes that were split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 in leaves
    cut: np.ndarray      # values below it go left
    left: np.ndarray     # the right child is the next number
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return self.value[node]
            right = x[rows, np.maximum(f, 0)] >= self.cut[node]
            node = np.where(inner, self.left[node] + right, node)


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)
    gain: np.ndarray | None = None
    splits: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def importance(self) -> np.ndarray:
        """Mean gain of a feature's splits, as a share of all features'."""
        mean = np.divide(self.gain, self.splits, out=np.zeros_like(self.gain), where=self.splits > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean


def _bin_edges(x: np.ndarray, max_bins: int) -> np.ndarray:
    """Cut values between neighbouring distinct values (or between quantiles)."""
    u = np.unique(x)
    if len(u) > max_bins:
        u = np.unique(np.quantile(x, np.linspace(0, 1, max_bins), method="inverted_cdf"))
    return (u[1:] + u[:-1]) / 2


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 300, depth: int = 6, rate: float = 0.1, l2: float = 1.0,
                min_child: float = 1.0, min_gain: float = 0.0, max_bins: int = 256) -> Boosted:
    """Fit on rows ``x`` (finite numbers) with targets ``y``."""
    n, k = x.shape
    edges = [_bin_edges(x[:, j], max_bins) for j in range(k)]
    bins = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]) if n else np.zeros((0, k), int)
    width = max([len(e) for e in edges], default=0) + 1
    place = bins + np.arange(k) * width  # of a row's bins within one node's histogram
    # a cut after the last bin of a feature separates nothing
    real = np.arange(width)[None, :] < np.array([len(e) for e in edges])[:, None]
    model = Boosted(float(y.mean()) if n else 0.0, gain=np.zeros(k), splits=np.zeros(k))
    pred = np.full(n, model.base)
    for _ in range(rounds):
        g = pred - y
        node = np.zeros(n, np.int64)
        feature, cut, left, value = [-1], [0.0], [-1], [-g.sum() / (n + l2)]
        open_nodes, rows = np.array([0]), np.arange(n)  # nodes of this level, rows inside them
        slot = np.zeros(n, np.int64)  # a row's place among open_nodes
        for _ in range(depth):
            m = len(open_nodes)
            at = (place[rows] + slot[rows, None] * (k * width)).ravel()
            gh = np.bincount(at, weights=np.repeat(g[rows], k), minlength=m * k * width).reshape(m, k, width)
            hh = np.bincount(at, minlength=m * k * width).reshape(m, k, width).astype(float)
            gl, hl = gh.cumsum(axis=2), hh.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - gt * gt / (ht + l2)
            gain[(hl < min_child) | (hr < min_child) | ~real] = -np.inf
            flat = gain.reshape(m, -1)
            best = flat.argmax(axis=1)
            top = flat[np.arange(m), best]
            grown = np.flatnonzero(top > max(min_gain, 1e-12 * max(1.0, float(np.abs(gt).max()) ** 2)))
            if not len(grown):
                break
            f, b = best[grown] // width, best[grown] % width
            first = len(feature) + 2 * np.arange(len(grown))
            for i, s in enumerate(grown):
                p, j, c = open_nodes[s], f[i], b[i]
                feature[p], cut[p], left[p] = int(j), edges[j][c], int(first[i])
                for gs, hs in ((gl[s, j, c], hl[s, j, c]), (gr[s, j, c], hr[s, j, c])):
                    feature.append(-1)
                    cut.append(0.0)
                    left.append(-1)
                    value.append(-gs / (hs + l2))
                model.gain[j] += top[s]
                model.splits[j] += 1
            new_slot = np.full(m, -1)
            new_slot[grown] = np.arange(len(grown))
            mine = new_slot[slot[rows]]
            rows, mine = rows[mine >= 0], mine[mine >= 0]
            right = bins[rows, f[mine]] > b[mine]
            node[rows] = first[mine] + right
            slot[rows] = 2 * mine + right
            open_nodes = (first[:, None] + np.arange(2)).ravel()
        tree = Tree(np.array(feature), np.array(cut), np.array(left), rate * np.array(value))
        model.trees.append(tree)
        pred += tree.value[node]
    return model

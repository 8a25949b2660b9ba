"""Labelled samples (tables) and small learners (numpy, on the driver, over features of bounded samples only)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import materialise


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string")) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, *, folds: int, held: int, limit: int) -> DataFrame:
    """(h, y, t): at most ``limit`` labelled rows that are not held out, those of least hash of the key, so the same ones each time.

    Rows that repeat id and text count once. Where labels of one id differ, 1 counts. The rows are a
    table in the shared folder; h is a hash of id and text.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(fold(F.col("k"), folds) != held)
    # The ids are chosen before their texts are joined, so only the sample's texts travel.
    chosen = marks.where(fold(F.col("k"), folds) != held).orderBy(F.xxhash64("k"), "k").limit(limit)
    found = rows.join(F.broadcast(chosen), "k").groupBy(F.xxhash64("k", "t").alias("h")).agg(F.max("y").alias("y"), F.first("t").alias("t"))
    sample = materialise(found, "labelled")
    if sample.count() > limit:  # ids with many texts
        edge = sample.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
        sample = sample.where(F.col("h") <= edge)
    return sample


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0  # left: x <= threshold
    left: Node | None = None
    right: Node | None = None

    def paths(self, above: tuple = ()) -> list[tuple]:
        """Conditions (feature, is_left, threshold) that lead to each node below the root."""
        out = [above] if above else []
        if self.left is not None:
            out += self.left.paths((*above, (self.feature, True, self.threshold)))
            out += self.right.paths((*above, (self.feature, False, self.threshold)))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.predict(x), self.right.predict(x))

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        return F.when(features[self.feature] <= F.lit(float(self.threshold)), self.left.column(features)).otherwise(self.right.column(features))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds between distinct values of each feature, at most ``bins`` quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        out.append(mid if len(mid) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 2)[1:-1])))
    return out


def _grow(codes, cuts, g, h, w, rows, depth, least, lam) -> Node:
    gs, hs = g[rows].sum(), h[rows].sum()
    node = Node(-gs / (hs + lam))
    if depth == 0:
        return node
    best = (1e-6, -1, -1)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        k = codes[rows, j]
        cg, ch, cw = (np.cumsum(np.bincount(k, v[rows], len(c) + 1))[:-1] for v in (g, h, w))
        ok = (cw >= least) & (w[rows].sum() - cw >= least)
        gain = np.where(ok, cg**2 / (ch + lam) + (gs - cg) ** 2 / (hs - ch + lam) - gs**2 / (hs + lam), -1)
        t = int(gain.argmax())
        if gain[t] > best[0]:
            best = (gain[t], j, t)
    if best[1] < 0:
        return node
    _, j, t = best
    goes = codes[rows, j] <= t
    node.feature, node.threshold = j, float(cuts[j][t])
    node.left = _grow(codes, cuts, g, h, w, rows[goes], depth - 1, least, lam)
    node.right = _grow(codes, cuts, g, h, w, rows[~goes], depth - 1, least, lam)
    return node


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, *, trees: int, depth: int, rate: float = 0.3, bins: int = 32, least: float = 10, lam: float = 1.0) -> tuple[float, list[Node]]:
    """Gradient-boosted logistic trees on weighted rows: the first log-odds and the trees (values include the rate)."""
    w = np.ones(len(y)) if w is None else w
    cuts = cut_points(x, bins)
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = min(max((w * y).sum() / max(w.sum(), 1e-9), 1e-4), 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    z, out = np.full(len(y), base), []
    for _ in range(trees):
        p = sigmoid(z)
        tree = _grow(codes, cuts, w * (p - y), w * p * (1 - p), w, np.arange(len(y)), depth, least, lam)
        if tree.left is None:
            break
        stack = [tree]
        while stack:
            n = stack.pop()
            n.value *= rate
            stack += [m for m in (n.left, n.right) if m is not None]
        z += tree.predict(x)
        out.append(tree)
    return base, out


def lasso_logistic(m: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + l1 * |weights| (accelerated proximal gradient)."""
    n, k = m.shape
    scale = 4.0 / max(np.linalg.norm(m.T @ m / n, 2) if k else 1.0, 1e-9) if k else 1.0
    step = scale / 2
    b, w = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(k)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(steps):
        r = sigmoid(m @ vw + vb) - y
        nb = vb - min(step, 2.0) * r.mean()
        nw = vw - step * (m.T @ r / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w

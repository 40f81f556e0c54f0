"""Gradient-boosted trees: fitted by Spark ML, scored in Arrow batches as flat arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage

HELD_ROWS = 100_000

_IF = re.compile(r"If \(feature (\d+) <= (\S+)\)")


@dataclass
class Boosted:
    """Trees as arrays: a node's feature (-1: leaf), threshold or value, and left and right nodes."""
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    slope: float = 2.0
    offset: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)  # by group: the probability to select from

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                open_ = np.flatnonzero(f >= 0)
                if not len(open_):
                    break
                node = at[open_]
                low = x[open_, f[open_]] <= self.value[node]
                at[open_] = np.where(low, self.left[node], self.right[node])
            out += weight * self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1 for each row of features."""
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def constant(p: float) -> Boosted:
    """A model of one leaf, for samples of a single class."""
    one = np.array([0])
    return Boosted(np.array([-1]), np.array([1.0 if p >= 0.5 else -1.0]), one, one, one, np.array([1.0]))


def _parse(text: str, weights: list[float]) -> Boosted:
    feature, value, left, right, roots = [], [], [], [], []

    def node(lines) -> int:
        line, me = next(lines), len(feature)
        for column in (feature, value, left, right):
            column.append(-1)
        if line.startswith("Predict"):
            value[me] = float(line.split()[-1])
            return me
        found = _IF.match(line)
        feature[me], value[me] = int(found[1]), float(found[2])
        left[me] = node(lines)
        next(lines)  # the Else line
        right[me] = node(lines)
        return me

    lines = iter([s for s in map(str.strip, text.splitlines()) if s.startswith(("If", "Else", "Predict"))])
    for _ in weights:
        roots.append(node(lines))
    return Boosted(np.array(feature), np.array(value, dtype=float), np.array(left), np.array(right),
                   np.array(roots), np.array(weights))


def calibrate(model: Boosted, x: np.ndarray, label: np.ndarray) -> Boosted:
    """Set slope and offset by logistic regression of the labels on the margin."""
    z, y = model.margin(x), label.astype(float)
    if not 0 < y.sum() < len(y):
        return model
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((target - p) * z).sum(), (target - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(a), float(b)
    return model


def fit(rows: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7, group: str | None = None,
        precision: float = 0.99) -> Boosted:
    """Fit on rows of (features array<double>, label 0.0 or 1.0, held boolean[, group int]); held rows calibrate.

    The rows come from a bounded sample; of the held ones at most about HELD_ROWS are collected, chosen by
    a hash of their features. With `group` each group gets the lowest threshold from which on the held
    rows reach the precision.
    """
    cols = ["features", "label", "held", *([group] if group else [])]
    rows = stage(rows.select(*cols), "examples")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("held", "label").count().collect()}
    fitted = {label: n for (held, label), n in counts.items() if not held}
    if len(fitted) < 2:
        return constant(max(fitted, key=fitted.get, default=0.0))
    vectors = rows.where("not held").select(array_to_vector("features").alias("features"), "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(vectors)
    out = _parse(model.toDebugString, list(model.treeWeights))
    parts = -(-sum(n for (held, _), n in counts.items() if held) // HELD_ROWS)
    held = rows.where("held").where(F.pmod(F.xxhash64("features"), F.lit(max(1, parts))) == 0).select(*cols).collect()
    if held:
        x, y = np.array([r[0] for r in held]), np.array([r[1] for r in held])
        out = calibrate(out, x, y)
        if group:
            p, of = out.probability(x), np.array([r[3] for r in held])
            out.thresholds = {int(g): lowest_threshold(p[of == g], y[of == g], precision) for g in np.unique(of)}
    return out


def lowest_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability, at least one half, from which on the share of label 1 is at least `precision`.

    One more row is counted that is right with the calibrated probability itself, so that few rows alone do not
    prove a precision; 2 if no probability has it.
    """
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(p[order][1:] != p[order][:-1], True)  # rows of equal probability go together
    good = last & (hits + p[order] >= precision * (np.arange(1, len(p) + 1) + 1)) & (p[order] >= 0.5)
    return float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 2.0


def calibration_part(key: str, parts: int = 4) -> Column:
    """Whether a row's hash puts it into the calibration part."""
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(parts)) == 0

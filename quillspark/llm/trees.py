"""Small decision-tree ensembles: grown on the driver over counted feature patterns, scored as Column expressions.

Features are small integers, so the distinct patterns of a training set are few
however many rows it has; a tree's nodes become nested CASE expressions, which
Spark compiles.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Pattern = tuple[tuple[int, ...], int, float]  # features, label 0 or 1, weight


@dataclass
class Node:
    value: float
    feature: int = -1
    most: int = 0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: tuple[int, ...]) -> float:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.most else node.high
        return node.value

    def column(self, names: list[str]) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(F.col(names[self.feature]) <= self.most, self.low.column(names)).otherwise(self.high.column(names))


def grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, ridge: float, least: float, pick=None) -> Node:
    """A tree on rows (features, g, h): leaves are G / (H + ridge), splits maximise G^2 / (H + ridge)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    node = Node(g / (h + ridge))
    if depth == 0 or len(rows) < 2:
        return node
    features = range(len(rows[0][0]))
    best = (g * g / (h + ridge) + 1e-9, -1, 0)
    for f in pick(list(features)) if pick else features:
        by: dict[int, list[float]] = {}
        for x, gi, hi in rows:
            sums = by.setdefault(x[f], [0.0, 0.0])
            sums[0] += gi
            sums[1] += hi
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            if hl < least or h - hl < least:
                continue
            gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge)
            if gain > best[0]:
                best = (gain, f, v)
    if best[1] < 0:
        return node
    _, node.feature, node.most = best
    node.low = grow([r for r in rows if r[0][node.feature] <= node.most], depth - 1, ridge, least, pick)
    node.high = grow([r for r in rows if r[0][node.feature] > node.most], depth - 1, ridge, least, pick)
    return node


@dataclass
class Ensemble:
    """Boosted trees (a probability by the logistic of their sum) or a forest (their mean)."""

    trees: list[Node]
    base: float
    boosted: bool

    def predict(self, x: tuple[int, ...]) -> float:
        if self.boosted:
            return 1 / (1 + math.exp(-self.base - sum(t.predict(x) for t in self.trees)))
        return sum(t.predict(x) for t in self.trees) / len(self.trees)

    def column(self, names: list[str]) -> Column:
        total = F.lit(self.base if self.boosted else 0.0)
        for t in self.trees:
            total = total + t.column(names)
        return 1 / (1 + F.exp(-total)) if self.boosted else total / len(self.trees)


def boost(rows: list[Pattern], *, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Ensemble:
    """Gradient-boosted trees for the log-loss, by Newton steps."""
    share = (sum(w * y for _, y, w in rows) + 0.5) / (sum(w for *_, w in rows) + 1)
    base = math.log(share / (1 - share))
    sums, trees = [base] * len(rows), []
    for _ in range(rounds):
        steps = []
        for (x, y, w), s in zip(rows, sums):
            p = 1 / (1 + math.exp(-s))
            steps.append((x, w * (y - p), w * max(p * (1 - p), 1e-6)))
        tree = grow(steps, depth, ridge, 1e-3)
        shrink(tree, rate)
        trees.append(tree)
        sums = [s + tree.predict(x) for (x, *_), s in zip(rows, sums)]
    return Ensemble(trees, base, True)


def shrink(node: Node, rate: float) -> None:
    node.value *= rate
    if node.low is not None:
        shrink(node.low, rate)
        shrink(node.high, rate)


def forest(rows: list[Pattern], *, size: int = 40, depth: int = 6, seed: int = 5) -> Ensemble:
    """A random forest: Poisson bootstrap, about the root of the features at each split."""
    rng = random.Random(seed)
    trees = []
    for _ in range(size):
        drawn = []
        for x, y, w in rows:
            n = sum(rng.random() < 0.5 for _ in range(2)) if w <= 1 else rng.gauss(w, math.sqrt(w))
            if n > 0:
                drawn.append((x, n * y, n))
        pick = lambda fs: rng.sample(fs, max(1, round(math.sqrt(len(fs)) + 0.5)))
        trees.append(grow(drawn or [(x, w * y, w) for x, y, w in rows], depth, 1e-6, 0.5, pick))
    return Ensemble(trees, 0.0, False)


def threshold(scored: list[tuple[float, int, float]], precision: float) -> float:
    """Least score from which on the (score, label, weight) rows reach the precision; over 1 if none does."""
    best, hit, total = 1.01, 0.0, 0.0
    scored = sorted(scored, reverse=True)
    for i, (s, y, w) in enumerate(scored):
        hit, total = hit + w * y, total + w
        if (i + 1 == len(scored) or scored[i + 1][0] < s) and hit / total >= precision:
            best = s
    return best

"""Online random-cut forest: trees of random cuts that take a point in and let one go in the depth of the tree.

Every node knows the box around its points and how many they are. A point that comes in walks down from the root; at
each node one cut is drawn over the box widened by the point. A cut that parts the point from the box makes a leaf
there, another lets the walk go on. That is the distribution of a tree drawn anew over all points, at the cost of one
path. A point's score is its collusive displacement: of all subtrees that hold it, the largest ratio of the points
beside the subtree to those in it.

Trees hold the last ``most`` points. Nodes lie in flat lists, so that a forest is a value to store in a stream's state:
its size depends on ``trees`` and ``most`` alone, not on the length of the series.

Defined results: equal points share a leaf; a tree of one leaf displaces nothing; the first ``shingle - 1`` values of a
series score 0.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCORES = "series_id string, ts timestamp, value double, score double"


class RandomCutTree:
    """Tree of random cuts over the last points; the score of a point is what its insertion displaces."""

    def __init__(self, rng: np.random.Generator, most: int = 256):
        self.rng, self.most, self.root = rng, most, -1
        self.up, self.left, self.right, self.dim, self.cut, self.n, self.lo, self.hi = ([] for _ in range(8))
        self.free: list[int] = []
        self.order: deque[int] = deque()  # leaves by arrival of their points
        self.visited = 0

    def _node(self, lo: tuple, hi: tuple, n: int) -> int:
        fresh = {"up": -1, "left": -1, "right": -1, "dim": -1, "cut": 0.0, "n": n, "lo": lo, "hi": hi}
        if self.free:
            at = self.free.pop()
            for name, x in fresh.items():
                getattr(self, name)[at] = x
            return at
        for name, x in fresh.items():
            getattr(self, name).append(x)
        return len(self.n) - 1

    def _replace(self, old: int, new: int, above: int) -> None:
        """``new`` takes the place of ``old`` below ``above``, or at the root."""
        self.up[new] = above
        if above < 0:
            self.root = new
        elif self.left[above] == old:
            self.left[above] = new
        else:
            self.right[above] = new

    def insert(self, point: Iterable[float]) -> int:
        """Take a point in; its leaf."""
        p = tuple(float(x) for x in point)
        p = tuple(x / (4 * len(p)) for x in p)  # so that no sum of extents overflows
        at = self.root
        leaf = -1
        while at >= 0:
            self.visited += 1
            lo, hi = self.lo[at], self.hi[at]
            low, spans = tuple(map(min, lo, p)), [max(b, x) - min(a, x) for a, b, x in zip(lo, hi, p, strict=True)]
            total = sum(spans)
            if total == 0:  # a leaf of points equal to this one
                leaf = at
                break
            r, d = self.rng.random() * total, 0
            while d < len(spans) - 1 and r >= spans[d]:
                r -= spans[d]
                d += 1
            cut = low[d] + r
            if p[d] <= cut < lo[d] or hi[d] <= cut < p[d]:
                leaf = self._node(p, p, 0)
                branch = self._node(low, tuple(map(max, hi, p)), self.n[at])
                self._replace(at, branch, self.up[at])
                self.dim[branch], self.cut[branch] = d, cut
                self.left[branch], self.right[branch] = (leaf, at) if p[d] <= cut else (at, leaf)
                self.up[leaf] = self.up[at] = branch
                break
            if self.left[at] >= 0:  # at a leaf only a cut rounded to the box's edge gets here: it is drawn again
                at = self.left[at] if p[self.dim[at]] <= self.cut[at] else self.right[at]
        if leaf < 0:
            leaf = self.root = self._node(p, p, 0)
        self.order.append(leaf)
        at = leaf
        while at >= 0:
            self.visited += 1
            self.n[at] += 1
            self.lo[at], self.hi[at] = tuple(map(min, self.lo[at], p)), tuple(map(max, self.hi[at], p))
            at = self.up[at]
        return leaf

    def forget(self, leaf: int) -> None:
        """Let one point of a leaf go."""
        at = leaf
        if self.n[leaf] == 1:
            above = self.up[leaf]
            self.free.append(leaf)
            if above < 0:
                self.root = -1
                return
            beside = self.right[above] if self.left[above] == leaf else self.left[above]
            self._replace(above, beside, self.up[above])
            self.free.append(above)
            at = self.up[beside]
        while at >= 0:
            self.visited += 1
            self.n[at] -= 1
            if self.left[at] >= 0:
                a, b = self.left[at], self.right[at]
                self.lo[at], self.hi[at] = tuple(map(min, self.lo[a], self.lo[b])), tuple(map(max, self.hi[a], self.hi[b]))
            at = self.up[at]

    def displacement(self, leaf: int) -> float:
        best, at = 0.0, leaf
        while (above := self.up[at]) >= 0:
            self.visited += 1
            best = max(best, (self.n[above] - self.n[at]) / self.n[at])
            at = above
        return best

    def score(self, point: Iterable[float]) -> float:
        """What a point would displace that does not stay."""
        leaf = self.insert(point)
        out = self.displacement(leaf)
        self.order.pop()
        self.forget(leaf)
        return out

    def update(self, point: Iterable[float]) -> float:
        """Take a point in, the oldest one going where the tree is full; its score."""
        if len(self.order) >= self.most:
            self.forget(self.order.popleft())
        return self.displacement(self.insert(point))


class RandomCutForest:
    """Trees over shingles of the last values of one series."""

    def __init__(self, shingle: int = 4, trees: int = 20, most: int = 256, seed: int = 100):
        self.shingle = shingle
        self.trees = [RandomCutTree(np.random.default_rng(seed + k), most) for k in range(trees)]
        self.last: list[float] = []

    def push(self, value: float) -> float:
        """Score of the shingle that ends with ``value``, which is then part of the forest."""
        self.last = [*self.last, float(value)][-self.shingle :]
        if len(self.last) < self.shingle:
            return 0.0
        return sum(t.update(self.last) for t in self.trees) / len(self.trees)

    def stored(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    @staticmethod
    def restored(state: bytes) -> RandomCutForest:
        """A forest from the state that the same query stored."""
        return pickle.loads(state)  # noqa: S301


def forest_scores(df: DataFrame, shingle: int = 4, trees: int = 20, most: int = 256) -> DataFrame:
    """(series_id, ts, value, score) of every finite point of a table, series by series in order of time."""
    from tidemark.operators.grouped import per_series

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = RandomCutForest(shingle, trees, most)
        return pdf.assign(score=[forest.push(x) for x in pdf.value])

    return per_series(df, work, SCORES)

"""Nearest points in numpy: a tree of boxes, and cuts of space into leaves. Everything is compared by one formula of the squared distance."""

from __future__ import annotations

import numpy as np

#: Pairs of points and boxes, or of points, that are looked at together.
MOST_PAIRS = 200_000


class Metric:
    """Weighted squared distance, added up in the order of the dimensions as ``joins.distance_squared`` does; circular ones have period 1."""

    def __init__(self, weights: list[float], circular: list[bool]):
        self.squares, self.circular = [w * w for w in weights], circular

    def _sum(self, gaps) -> np.ndarray:
        out = 0.0
        for k, gap in enumerate(gaps):
            out = out + self.squares[k] * gap * gap
        return out

    def _gap(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.abs(a - b)
        return np.minimum(gap, 1 - gap) if self.circular[k] else gap

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._sum(self._gap(k, a[..., k], b[..., k]) for k in range(len(self.squares)))

    def to_box(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Never above ``between`` of a and a point of the box, in floating point too: each step is monotonic, and a gap is least at an end."""
        return self._sum(
            np.where((a[:, k] >= low[:, k]) & (a[:, k] <= high[:, k]), 0.0, np.minimum(self._gap(k, a[:, k], low[:, k]), self._gap(k, a[:, k], high[:, k])))
            for k in range(len(self.squares))
        )


class Tree:
    """Points halved along their widest dimension until a bucket has about ``held`` of them; boxes are tight."""

    def __init__(self, points: np.ndarray, metric: Metric, held: int = 12):
        self.metric, n = metric, len(points)
        self.levels = max(0, int(np.ceil(np.log2(n / held))))
        order = np.arange(n)
        for level in range(self.levels):
            ends = np.arange(2**level + 1) * n >> level
            at = points[order]
            spread = (np.maximum.reduceat(at, ends[:-1]) - np.minimum.reduceat(at, ends[:-1])) * np.sqrt(metric.squares)
            node = np.repeat(np.arange(2**level), np.diff(ends))
            order = order[np.lexsort((at[np.arange(n), spread.argmax(1)[node]], node))]
        self.ends = np.arange(2**self.levels + 1) * n >> self.levels
        self.order, self.points = order, points[order]
        self.low, self.high = [np.minimum.reduceat(self.points, self.ends[:-1])], [np.maximum.reduceat(self.points, self.ends[:-1])]
        for _ in range(self.levels):
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
        self.width = int(np.diff(self.ends).max())

    def nearest(self, q: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and number of the nearest point, the least number on ties; number -1 where none is within the squared ``bound``."""
        best = np.full(len(q), np.inf) if bound is None else bound.astype(float)
        found = np.full(len(q), len(self.order))
        for a in range(0, len(q), step := max(1, MOST_PAIRS // (4 * self.width))):
            at = np.arange(a, min(len(q), a + step))
            node = np.zeros(len(at), int)
            for level in range(1, self.levels + 1):  # into the nearer box, for a first bound
                both = [self.metric.to_box(q[at], self.low[level][2 * node + k], self.high[level][2 * node + k]) for k in (0, 1)]
                node = 2 * node + (both[1] < both[0])
            self._look(q, at, node, best, found)
            self._down(q, at, np.zeros(len(at), int), 0, best, found)
        return best, np.where(found == len(self.order), -1, found)

    def _down(self, q, at, node, level, best, found) -> None:
        while True:
            if len(at) > max(1, MOST_PAIRS // self.width):
                half = len(at) // 2  # what the first half finds spares boxes of the second
                self._down(q, at[:half], node[:half], level, best, found)
                at, node = at[half:], node[half:]
            near = self.metric.to_box(q[at], self.low[level][node], self.high[level][node]) <= best[at]
            at, node = at[near], node[near]
            if level == self.levels:
                return self._look(q, at, node, best, found)
            at, node, level = np.repeat(at, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), level + 1

    def _look(self, q, at, node, best, found) -> None:
        """Compare points with all of their buckets."""
        if not len(at):
            return
        place = np.minimum(self.ends[node][:, None] + np.arange(self.width), self.ends[node + 1][:, None] - 1)
        d = self.metric.between(q[at][:, None, :], self.points[place])
        least = d.min(1)
        number = np.where(d == least[:, None], self.order[place], len(self.order)).min(1)
        by = np.lexsort((number, least, at))
        by = by[np.r_[True, np.diff(at[by]) > 0]]
        at, least, number = at[by], least[by], number[by]
        better = (least < best[at]) | ((least == best[at]) & (number < found[at]))
        best[at[better]], found[at[better]] = least[better], number[better]


class Leaves:
    """Space cut in 2 ** levels leaves at medians of a sample; every point lies in exactly one."""

    def __init__(self, sample: np.ndarray, metric: Metric, levels: int):
        self.metric, self.levels = metric, levels
        self.dim, self.cut = np.zeros(2**levels - 1, int), np.full(2**levels - 1, np.inf)
        ends = [np.array([0.0 if c else -np.inf for c in metric.circular]), np.array([1.0 if c else np.inf for c in metric.circular])]
        self.low, self.high = np.tile(ends[0], (2 ** (levels + 1) - 1, 1)), np.tile(ends[1], (2 ** (levels + 1) - 1, 1))
        held = {0: sample}
        for node in range(2**levels - 1):
            mine = held.pop(node)
            if len(mine):
                k = int(((mine.max(0) - mine.min(0)) * np.sqrt(metric.squares)).argmax())
                above = mine[mine[:, k] > mine[:, k].min(), k]
                if len(above):  # else one place only: all of it stays left
                    self.dim[node], self.cut[node] = k, max(np.partition(mine[:, k], len(mine) // 2)[len(mine) // 2], above.min())
            left = mine[:, self.dim[node]] < self.cut[node]
            for child, part in ((2 * node + 1, mine[left]), (2 * node + 2, mine[~left])):
                held[child] = part
                self.low[child], self.high[child] = self.low[node], self.high[node]
            if np.isfinite(self.cut[node]):
                self.high[2 * node + 1, self.dim[node]] = self.low[2 * node + 2, self.dim[node]] = self.cut[node]
            else:
                self.low[2 * node + 2], self.high[2 * node + 2] = np.inf, np.inf

    def of(self, points: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(points), int), np.arange(len(points))
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[row, self.dim[node]] >= self.cut[node])
        return node - (2**self.levels - 1)

    def within(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point's number and a leaf that is no farther than the squared bound."""
        at, node = np.arange(len(q)), np.zeros(len(q), int)
        for _ in range(self.levels):
            at, node = np.repeat(at, 2), np.repeat(2 * node + 1, 2) + np.tile([0, 1], len(node))
            near = np.isfinite(self.cut[(node - 1) // 2]) | (node % 2 == 1)
            at, node = at[near], node[near]
            near = self.metric.to_box(q[at], self.low[node], self.high[node]) <= bound[at]
            at, node = at[near], node[near]
        return at, node - (2**self.levels - 1)

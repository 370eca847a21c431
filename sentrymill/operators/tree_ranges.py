"""Ranges of values that can hold the best split of a tree's node, found by bounds, for trees on many rows.

Every feature is divided into fine ranges by quantiles of all its rows. One pass sums up the classes of each open node
in each range, in numpy arrays of a task, which are added up by node. Sums at the end of a range are those of a split there. A split
inside a range has sums between those at its begin and end, and since the impurity of both sides weighted by their rows is a
concave function of them, it is at least as much as at one of the corners: all rows of some classes to the left and
none of the others. A range with a bound above the best end of any range of its node can't hold the best split. A second pass gives the
values of the rows in what is left, so that each of them is tried. No split is left out that could be best, equal ones included.

A node has about a range for every ``ROWS_A_RANGE`` of its rows, fewer where all together would take more than ``CELLS`` numbers a
task. A value of many rows gets a range of its own, whose only split is its end.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FINE, POINTS, ROWS_A_RANGE, CELLS = 8_192, 4_096, 400, 4_000_000
#: The corners double with every class.
MOST_CLASSES = 8
#: Of the rows of a node; scores are compared to 12 digits.
SLACK = 1e-9
SUMMED, FOUND, VALUES = "slot int, sums binary", "slot int, f int, r int, v double, own array<double>, before array<double>", "tree int, node int, f int, range int, v double, c int, w double"


def _blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The features of each batch, one row of the array for each feature."""
    for b in batches:
        if b.num_rows:
            yield np.ascontiguousarray(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width).T), b


def _picked(values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n quantiles of weighted values."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return values[order][np.minimum(np.searchsorted(upto, (np.arange(n) + 0.5) / n * upto[-1]), len(values) - 1)]


def fine_cuts(rows: DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """About FINE quantiles of each feature over all rows, and of each range up to one how many of them its only value is.

    A value that is several of them is cut off on both sides; other ranges have 0. The last range has no end.
    """

    def run(batches):
        levels: dict[int, np.ndarray] = {}  # buffers of POINTS values, each for 2 ** level rows
        rest = np.empty((width, 0))
        for x, _ in _blocks(batches, width):
            rest = np.concatenate([rest, x], axis=1)
            while rest.shape[1] >= POINTS:
                held, rest, level = np.sort(rest[:, :POINTS], axis=1), rest[:, POINTS:], 0
                while level in levels:
                    held, level = np.sort(np.concatenate([levels.pop(level), held], axis=1), axis=1)[:, level % 2 :: 2], level + 1
                levels[level] = held
        parts = [(v, float(1 << level)) for level, v in levels.items()] + ([(rest, 1.0)] if rest.shape[1] else [])
        if parts:
            weights = np.concatenate([np.full(v.shape[1], w) for v, w in parts])
            points = np.stack([_picked(np.concatenate([v[f] for v, _ in parts]), weights, POINTS // 2) for f in range(width)])
            yield pa.RecordBatch.from_pydict({"n": [float(weights.sum())], "points": [points.tobytes()]})

    tasks = [(r.n, np.frombuffer(r.points).reshape(width, -1)) for r in rows.mapInArrow(run, "n double, points binary").collect()]  # one row per task
    weights = np.concatenate([np.full(p.shape[1], n) for n, p in tasks])
    out = []
    for f in range(width):
        cuts, times = np.unique(_picked(np.concatenate([p[f] for _, p in tasks]), weights, FINE), return_counts=True)
        cuts, times = cuts[~np.isnan(cuts)], times[~np.isnan(cuts)]
        own, many = np.unique(np.concatenate([cuts, np.nextafter(cuts[times > 1], -np.inf)])), cuts[times > 1]
        alone = np.zeros(len(own) + 1, np.int64)
        alone[np.searchsorted(own, many)] = times[times > 1]
        out.append((own, alone))
    return out


def _merged(cuts: np.ndarray, alone: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each fine one where 2 ** shift of them make one, and the only value of each or NaN; values as frequent as a range stay alone."""
    single = alone >= max(2, 1 << shift)
    begins = single | (np.arange(len(alone)) % (1 << shift) == 0)
    begins[1:] |= single[:-1]
    to = begins.cumsum() - 1
    value = np.full(to[-1] + 1, np.nan)
    value[to[single]] = cuts[np.flatnonzero(single)]
    return to, value


def _mass(kind: str, sums: np.ndarray) -> np.ndarray:
    """Impurity times rows."""
    n = sums.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "gini":
            return np.where(n > 0, n - (sums * sums).sum(-1) / n, 0.0)
        log = lambda v: np.where(v > 0, v * np.log2(v), 0.0)
        return log(n) - log(sums).sum(-1)


class Level:
    """The open nodes (tree, node) of a level and their ranges."""

    def __init__(self, trees: list, open_: list[tuple[int, int]], cuts: list[tuple[np.ndarray, np.ndarray]], kind: str, classes: list[float], min_leaf: int):
        self.cuts, self.kind, self.classes, self.min_leaf, self.open_ = [c for c, _ in cuts], kind, np.array(classes), min_leaf, open_
        self.width, self.c = len(cuts), len(classes)
        self.totals = np.array([trees[t].nodes[i].sums for t, i in open_])
        n = self.totals.sum(1)
        a_range = max(ROWS_A_RANGE, n.sum() * self.width * self.c / CELLS)
        fine = np.array([len(c) + 1 for c in self.cuts])
        self.shift = np.maximum(0, np.ceil(np.log2(fine[None, :] / np.maximum(1, n[:, None] / a_range)))).astype(np.int64)
        merged = [[_merged(*own, k) for k in range(self.shift[:, f].max() + 1)] for f, own in enumerate(cuts)]
        self.to = [np.stack([to for to, _ in own]) for own in merged]
        self.single = [[value for _, value in own] for own in merged]
        self.size = np.array([[len(self.single[f][k]) for f, k in enumerate(own)] for own in self.shift])  # ranges by slot and feature
        ends = self.size.ravel().cumsum()
        self.base, self.ranges = (ends - self.size.ravel()).reshape(self.size.shape), int(ends[-1])
        slots = {o: s for s, o in enumerate(open_)}
        self.trees = {}
        for t in sorted({t for t, _ in open_}):
            nodes = trees[t].nodes
            pick = lambda what, empty: np.array([empty if node.feature is None else getattr(node, what) for node in nodes])
            self.trees[t] = (pick("feature", -1), pick("threshold", 0.0), pick("left", 0), pick("right", 0), np.array([slots.get((t, i), -1) for i in range(len(nodes))]))
        self.depth = max(trees[t].nodes[i].depth for t, i in open_)

    def _placed(self, x: np.ndarray, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each tree, its rows in open nodes, their slots and weights."""
        weights = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        for t, (feature, threshold, left, right, slot) in self.trees.items():
            kept = np.flatnonzero(weights[:, t] > 0)
            at = np.zeros(len(kept), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[f, kept] <= threshold[at], left[at], right[at]))
            s = slot[at]
            is_open = s >= 0
            yield kept[is_open], s[is_open], weights[kept[is_open], t]

    def _cells(self, x: np.ndarray, b: pa.RecordBatch):
        """(feature, rows, slots, weights, range of each) of every tree and feature."""
        fine = [np.searchsorted(cuts, own) for cuts, own in zip(self.cuts, x)]
        for kept, slots, w in self._placed(x, b):
            for f in range(self.width):
                yield f, kept, slots, w, self.base[slots, f] + self.to[f][self.shift[slots, f], fine[f][kept]]

    def _class(self, b: pa.RecordBatch) -> np.ndarray:
        return np.searchsorted(self.classes, b.column(1).to_numpy(zero_copy_only=False))

    def summed(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(self.ranges * self.c)
        for x, b in _blocks(batches, self.width):
            y = self._class(b)
            for _, kept, _, w, at in self._cells(x, b):
                np.add.at(sums, at * self.c + y[kept], w)
        for s, (a, z) in enumerate(self._spans()):
            if sums[a * self.c : z * self.c].any():
                yield pa.RecordBatch.from_pydict({"slot": pa.array([s], pa.int32()), "sums": [sums[a * self.c : z * self.c].tobytes()]})

    def _spans(self) -> list[tuple[int, int]]:
        return [(int(self.base[s, 0]), int(self.base[s, -1] + self.size[s, -1])) for s in range(len(self.open_))]

    def found(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges of each node that can hold its best split, with their sums and those before them."""
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(data.as_buffer()).reshape(-1, self.c)
                held[s] = held[s] + own if s in held else own
        for s, sums in held.items():
            total, start, best, bounds = self.totals[s], int(self.base[s, 0]), np.inf, []
            for f in range(self.width):
                own = sums[self.base[s, f] - start : self.base[s, f] - start + self.size[s, f]]
                upto = own.cumsum(0)
                before = upto - own
                both = lambda left, total=total: _mass(self.kind, left) + _mass(self.kind, total - left)
                at_end = np.where((upto.sum(1) >= self.min_leaf) & ((total - upto).sum(1) >= self.min_leaf), both(upto), np.inf)
                best = min(best, at_end[own.sum(1) > 0].min(initial=np.inf))
                bound = np.min([both(before + own * np.array(corner)) for corner in itertools.product((0.0, 1.0), repeat=self.c)], axis=0)
                single = self.single[f][self.shift[s, f]]
                bound = np.where(np.isnan(single), bound, at_end)
                bounds.append((own, before, np.where(own.sum(1) > 0, bound, np.inf), single))
            limit = best + SLACK * total.sum()
            for f, (own, before, bound, single) in enumerate(bounds):
                r = np.flatnonzero((bound <= limit) & (bound < np.inf))
                if len(r):
                    v = [None if math.isnan(i) else i for i in single[r].tolist()]
                    yield pa.RecordBatch.from_pydict({
                        "slot": pa.array([s] * len(r), pa.int32()), "f": pa.array([f] * len(r), pa.int32()), "r": pa.array(r, pa.int32()), "v": pa.array(v, pa.float64()),
                        "own": pa.array(own[r].tolist(), pa.list_(pa.float64())), "before": pa.array(before[r].tolist(), pa.list_(pa.float64())),
                    })

    def values(self, wanted: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in wanted ranges."""
        for x, b in _blocks(batches, self.width):
            y, parts = self._class(b), []
            for f, kept, slots, w, at in self._cells(x, b):
                i = np.flatnonzero(wanted[at])
                if len(i):
                    parts.append((slots[i], np.full(len(i), f), at[i] - self.base[slots[i], f], x[f, kept[i]], y[kept[i]], w[i]))
            if parts:
                slot, f, r, v, c, w = (np.concatenate(p) for p in zip(*parts))
                tree, node = np.array(self.open_)[slot].T
                whole = [pa.array(a.astype(kind)) for a, kind in ((tree, np.int32), (node, np.int32), (f, np.int32), (r, np.int32), (v, np.float64), (c, np.int32), (w, np.float64))]
                yield pa.RecordBatch.from_arrays(whole, names=["tree", "node", "f", "range", "v", "c", "w"])


def promising(rows: DataFrame, level: Level) -> tuple[list, DataFrame]:
    """Rows (x, y, ws) to the ranges that can hold a best split, as FOUND, and the values in those of more than one value, as VALUES."""
    sums = rows.mapInArrow(level.summed, SUMMED).repartition("slot")
    found = sums.mapInArrow(level.found, FOUND).collect()  # at most CELLS / classes ranges
    wanted = np.zeros(level.ranges, bool)
    for r in found:
        if r.v is None:
            wanted[level.base[r.slot, r.f] + r.r] = True
    return found, rows.mapInArrow(lambda batches: level.values(wanted, batches), VALUES)

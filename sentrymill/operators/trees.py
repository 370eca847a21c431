"""Decision trees by exact greedy splits, and forests and boosting of them.

Trees grow level by level. A level is one pass over all rows, for all trees at once: rows are placed in
their open node by the splits so far (an expression, no row is rewritten), reduced to one row per node,
feature and distinct value before the shuffle, and summed up along the values. On many rows, classifiers first rule out
ranges of values that can't hold the best split (``tree_ranges``), which takes a pass more and leaves few values. The running sums have two
levels: values fall into up to ``CUTS`` + 1 ranges of their feature, sums are taken inside a range, and
the ranges' totals are added. So every distinct value is tried as a threshold (``x <= t`` goes left) and no
task holds a node. The driver holds the trees and, per level, one best split for each open node.

The best split has the least impurity of its sides weighted by their rows; of equal ones the first
feature and then the smallest threshold. A node is a leaf at ``max_depth``, below ``min_split`` rows, or
with an impurity below 1e-7. Impurities are compared after rounding to 12 digits, so that the order in which
sums are taken doesn't decide.

Defined results: features are arrays of doubles, a null one counts as 0.0; rows without a label or
features are left out; a table without rows raises; classes are the distinct labels, and of equally
frequent ones the smallest is a leaf's value. A bootstrap draws a Poisson number of copies with mean 1 of
each row, from a hash of its key, which is what drawing n of n rows comes to in a large table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.operators import tree_ranges as ranges
from sentrymill.operators.scoring import FlatTree
from sentrymill.sources.tables import checkpointed, small_rows

CUTS = 63
PURE = 1e-7
CLASS_BOUND = 1_000
#: Rows of all trees up to which all their values are tried at once.
DIRECT = 1_000_000
LOSS_EVERY, LOSS_ENOUGH = 10, 1e-4
#: Chances of at most 0, 1, ... 7 copies of a row, for a Poisson number with mean 1.
POISSON = tuple(sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(8))


@dataclass
class Node:
    n: float
    sums: list[float]
    impurity: float
    depth: int
    value: float
    feature: int | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def column(self, x: Column, leaf=None, at: int = 0) -> Column:
        """The leaf that ``x`` comes to as an expression: its value, or what ``leaf(index, node)`` gives."""
        node = self.nodes[at]
        if node.feature is None:
            return leaf(at, node) if leaf else F.lit(node.value)
        own = F.coalesce(F.get(x, F.lit(node.feature)), F.lit(0.0))
        return F.when(own <= node.threshold, self.column(x, leaf, node.left)).otherwise(self.column(x, leaf, node.right))

    def importances(self, features: int) -> list[float]:
        """Impurity that the splits of each feature take away, weighted by rows, as shares of all."""
        out = [0.0] * features
        for node in self.nodes:
            if node.feature is not None:
                a, b = self.nodes[node.left], self.nodes[node.right]
                out[node.feature] += node.n * node.impurity - a.n * a.impurity - b.n * b.impurity
        total = sum(out)
        return [v / total for v in out] if total > 0 else out

    def to_json(self) -> str:
        return json.dumps([asdict(n) for n in self.nodes])

    def flattened(self) -> FlatTree:
        """The tree in the arrays of a flat ensemble."""
        no = [n.feature is None for n in self.nodes]
        pick = lambda what, empty: tuple(empty if leaf else getattr(n, what) for n, leaf in zip(self.nodes, no))
        return FlatTree(pick("feature", -1), pick("threshold", 0.0), pick("left", 0), pick("right", 0), tuple(n.value if leaf else 0.0 for n, leaf in zip(self.nodes, no)))

    @staticmethod
    def from_json(text: str) -> Tree:
        return Tree([Node(**n) for n in json.loads(text)])


class Criterion:
    """Impurity from additive sums: counts of each class, or sum and sum of squares of a value."""

    def __init__(self, kind: str, classes: Sequence[float] = ()):
        if kind not in ("gini", "entropy", "mse"):
            raise ValueError(kind)
        self.kind, self.classes = kind, list(classes)
        self.size = 2 if kind == "mse" else len(self.classes)

    def parts(self, y: Column, w: Column) -> list[Column]:
        if self.kind == "mse":
            return [w * y, w * y * y]
        return [F.when(y == c, w).otherwise(F.lit(0.0)) for c in self.classes]

    def of(self, n: Column, sums: list[Column]) -> Column:
        if self.kind == "mse":
            return F.greatest(F.lit(0.0), sums[1] / n - (sums[0] / n) * (sums[0] / n))
        shares = [s / n for s in sums]
        if self.kind == "gini":
            return F.lit(1.0) - sum((p * p for p in shares[1:]), shares[0] * shares[0])
        terms = [F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0)) for p in shares]
        return sum(terms[1:], terms[0])

    def node(self, n: float, sums: Sequence[float], depth: int) -> Node:
        if self.kind == "mse":
            return Node(n, list(sums), max(0.0, sums[1] / n - (sums[0] / n) ** 2), depth, sums[0] / n)
        p = [s / n for s in sums]
        impurity = 1.0 - sum(q * q for q in p) if self.kind == "gini" else -sum(q * math.log2(q) for q in p if q > 0)
        return Node(n, list(sums), impurity, depth, self.classes[max(range(len(p)), key=lambda i: (p[i], -i))])


def _rows(df: DataFrame, features: str, label: str, key: str | None) -> DataFrame:
    filled = F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0)))
    kept = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    return kept.select(*([F.col(key).alias("key")] if key else []), filled.alias("x"), F.col(label).cast("double").alias("y"))


def _cuts(rows: DataFrame) -> list[list[float]]:
    """Up to CUTS values that divide each feature, only to spread the work."""
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, 1000).alias("c")).orderBy("f").collect()  # one row per feature
    return [sorted(set(r.c)) for r in found]


def _range_of(cuts: list[list[float]]) -> Column:
    table = F.array(*[F.array(*[F.lit(float(c)) for c in own]) for own in cuts])
    return F.size(F.filter(F.get(table, F.col("f")), lambda c: c < F.col("v")))


def candidate_splits(placed: DataFrame, totals: DataFrame, criterion: Criterion, cuts: list[list[float]], min_leaf: int = 1) -> DataFrame:
    """(tree, node, f, v, n, s0.., score) of every allowed split of rows (tree, node, w, x, y); totals has n and sums of each node."""
    names = [f"s{i}" for i in range(criterion.size)]
    w = F.col("w")
    long = placed.select("tree", "node", "w", *[c.alias(n) for n, c in zip(names, criterion.parts(F.col("y"), w))], F.posexplode("x").alias("f", "v"))
    by_value = long.groupBy("tree", "node", "f", "v").agg(F.sum("w").alias("n"), *[F.sum(n).alias(n) for n in names]).withColumn("range", _range_of(cuts))
    own = ["tree", "node", "f"]
    inside = Window.partitionBy(*own, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*own).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_value.groupBy(*own, "range").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    before = ranges.select(*own, "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"b_{c}") for c in ("n", *names)])
    upto = by_value.select(*own, "range", "v", *[F.sum(c).over(inside).alias(c) for c in ("n", *names)]).join(before, [*own, "range"])
    return _scored(upto.select(*own, "v", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in ("n", *names)]), totals, criterion, min_leaf)


def _scored(left: DataFrame, totals: DataFrame, criterion: Criterion, min_leaf: int) -> DataFrame:
    """Allowed splits with their score, of (tree, node, f, v) with the sums of the rows up to v."""
    own, names = ["tree", "node", "f"], [f"s{i}" for i in range(criterion.size)]
    both = left.join(F.broadcast(totals.select("tree", "node", *[F.col(c).alias(f"t_{c}") for c in ("n", *names)])), ["tree", "node"])  # one row per open node
    other = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", *names)}
    allowed = both.where((F.col("n") >= min_leaf) & (other["n"] >= min_leaf))
    score = (F.col("n") * criterion.of(F.col("n"), [F.col(c) for c in names]) + other["n"] * criterion.of(other["n"], [other[c] for c in names])) / F.col("t_n")
    return allowed.select(*own, "v", "n", *names, F.round(score, 12).alias("score"))


def _promising_splits(rows: DataFrame, level: ranges.Level, totals: DataFrame, criterion: Criterion, min_leaf: int) -> DataFrame:
    """As ``candidate_splits``, without those that can't be best, of rows (x, y, ws)."""
    names = [f"s{i}" for i in range(criterion.size)]
    found, values = ranges.promising(rows, level)
    own, sums = ["tree", "node", "f", "range"], ["n", *names]
    # Sums before a range come first in it, as a row without a value.
    known = [(*level.open_[r.slot], r.f, r.r, None, sum(r.before), *r.before) for r in found] + [(*level.open_[r.slot], r.f, r.r, r.v, sum(r.own), *r.own) for r in found if r.v is not None]
    known = rows.sparkSession.createDataFrame(known, "tree int, node int, f int, range int, v double, " + ", ".join(f"{c} double" for c in sums)).coalesce(1)
    parts = [F.sum(F.when(F.col("c") == i, F.col("w")).otherwise(F.lit(0.0))).alias(n) for i, n in enumerate(names)]
    by_value = values.groupBy(*own, "v").agg(F.sum("w").alias("n"), *parts).unionByName(known)
    inside = Window.partitionBy(*own).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    left = by_value.select("tree", "node", "f", "v", *[F.sum(c).over(inside).alias(c) for c in sums])
    return _scored(left.where("v IS NOT NULL"), totals, criterion, min_leaf)


def grow(rows: DataFrame, criterion: Criterion, weights: list[Column], cuts: list[list[float]] | None = None, max_depth: int = 10, min_split: int = 2, min_leaf: int = 1) -> list[Tree]:
    """One tree per weight column, all levels at once for all trees. Classes of more than DIRECT rows have their values tried only where ``tree_ranges`` can't rule them out."""
    spark = rows.sparkSession
    x, y = F.col("x"), F.col("y")
    sums = [F.struct(F.coalesce(F.sum(w), F.lit(0.0)), *[F.coalesce(F.sum(p), F.lit(0.0)) for p in criterion.parts(y, w)]) for w in weights]
    totals = rows.agg(*[s.alias(f"t{i}") for i, s in enumerate(sums)]).first()
    trees = []
    for own in totals:
        n, *parts = own
        if not n:
            raise ValueError("there are no rows to fit on")
        trees.append(Tree([criterion.node(n, parts, 0)]))
    open_ = {(t, 0) for t in range(len(trees))}
    wanted = lambda node: node.depth < max_depth and node.n >= min_split and node.impurity >= PURE
    open_ = {(t, i) for t, i in open_ if wanted(trees[t].nodes[i])}
    fine, weighted = None, rows
    if criterion.kind != "mse" and criterion.size <= ranges.MOST_CLASSES and sum(t.nodes[0].n for t in trees) > DIRECT:
        shortest, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if shortest == width > 0:
            # One pass of few tasks: each of them sums up all ranges.
            weighted = rows.select("x", "y", F.array(*[w.cast("double") for w in weights]).alias("ws")).coalesce(spark.sparkContext.defaultParallelism)
            fine = ranges.fine_cuts(weighted, width)
    if not fine and cuts is None:
        cuts = _cuts(rows)
    while open_:
        at = [
            F.struct(F.lit(t).alias("tree"), tree.column(x, lambda i, _, t=t: F.lit(i) if (t, i) in open_ else F.lit(None).cast("int")).alias("node"), w.cast("double").alias("w"))
            for t, (tree, w) in enumerate(zip(trees, weights, strict=True))
            if any(o[0] == t for o in open_)
        ]
        placed = rows.select(F.explode(F.array(*at)).alias("at"), "x", "y").where("at.node IS NOT NULL AND at.w > 0").select("at.*", "x", "y")
        names = ["n", *[f"s{i}" for i in range(criterion.size)]]
        known = spark.createDataFrame(
            [(t, i, float(trees[t].nodes[i].n), *map(float, trees[t].nodes[i].sums)) for t, i in sorted(open_)], "tree int, node int, " + ", ".join(f"{c} double" for c in names)
        )
        if fine:
            splits = _promising_splits(weighted, ranges.Level(trees, sorted(open_), fine, criterion.kind, criterion.classes, min_leaf), known, criterion, min_leaf)
        else:
            splits = candidate_splits(placed, known, criterion, cuts, min_leaf)
        best = splits.groupBy("tree", "node").agg(F.min(F.struct("score", "f", "v", *names)).alias("best")).collect()  # one row per open node
        fresh = set()
        for r in best:
            tree, b = trees[r.tree], r.best
            node = tree.nodes[r.node]
            node.feature, node.threshold, node.left, node.right = b.f, b.v, len(tree.nodes), len(tree.nodes) + 1
            left = [b[c] for c in names]
            right = [node.n - left[0], *[a - c for a, c in zip(node.sums, left[1:], strict=True)]]
            for n, *parts in (left, right):
                tree.nodes.append(criterion.node(n, parts, node.depth + 1))
                if wanted(tree.nodes[-1]):
                    fresh.add((r.tree, len(tree.nodes) - 1))
        open_ = fresh
    return trees


def _classes(rows: DataFrame) -> list[float]:
    return sorted(r[0] for r in small_rows(rows.select("y").distinct(), CLASS_BOUND))


def fit_classifier(df: DataFrame, features: str, label: str, criterion: str = "gini", **settings) -> Tree:
    rows = _rows(df, features, label, None).persist()
    try:
        return grow(rows, Criterion(criterion, _classes(rows)), [F.lit(1.0)], **settings)[0]
    finally:
        rows.unpersist()


def fit_regressor(df: DataFrame, features: str, label: str, **settings) -> Tree:
    rows = _rows(df, features, label, None).persist()
    try:
        return grow(rows, Criterion("mse"), [F.lit(1.0)], **settings)[0]
    finally:
        rows.unpersist()


def poisson_copies(key: str, tree: int, seed: int) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, by a hash of its key."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.lit(tree), F.col(key).cast("string")))
    u = F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") / float(1 << 48)
    first, *rest = POISSON
    return sum((F.when(u >= b, 1.0).otherwise(0.0) for b in rest), F.when(u >= first, 1.0).otherwise(0.0))


@dataclass
class Forest:
    """Trees on bootstrap samples; the class with most votes, the smallest of equals."""

    trees: list[Tree]
    classes: list[float]

    def column(self, x: Column) -> Column:
        votes = F.array(*[t.column(x) for t in self.trees])
        count = lambda c: F.size(F.filter(votes, lambda v: v == c))
        return F.array_max(F.array(*[F.struct(count(c).alias("n"), F.lit(-c).alias("c")) for c in self.classes]))["c"] * -1

    def share(self, x: Column, of: float = 1.0) -> Column:
        votes = F.array(*[t.column(x) for t in self.trees])
        return F.size(F.filter(votes, lambda v: v == of)) / F.lit(float(len(self.trees)))

    def importances(self, features: int) -> list[float]:
        each = [t.importances(features) for t in self.trees]
        return [sum(own) / len(each) for own in zip(*each)]


def fit_forest(df: DataFrame, features: str, label: str, key: str, trees: int = 20, criterion: str = "gini", seed: int = 42, bootstrap: bool = True, **settings) -> Forest:
    copies = [poisson_copies("key", t, seed) if bootstrap else F.lit(1.0) for t in range(trees)]
    rows = _rows(df, features, label, key).select("x", "y", F.array(*copies).alias("copies")).persist()
    try:
        classes = _classes(rows)
        return Forest(grow(rows, Criterion(criterion, classes), [F.get("copies", F.lit(t)) for t in range(trees)], **settings), classes)
    finally:
        rows.unpersist()


@dataclass
class Boosted:
    """Regression trees on the residuals of the log loss, added at a rate to the log odds of the labels."""

    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def score(self, x: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + self.rate * t.column(x)
        return out

    def probability(self, x: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-self.score(x)))

    def column(self, x: Column) -> Column:
        return F.when(self.probability(x) > 0.5, 1.0).otherwise(0.0)

    def importances(self, features: int) -> list[float]:
        sums = [sum(own) for own in zip(*[t.importances(features) for t in self.trees])] if self.trees else [0.0] * features
        return [v / sum(sums) for v in sums] if sum(sums) > 0 else sums


def fit_boosted(df: DataFrame, features: str, label: str, rounds: int = 100, rate: float = 0.1, max_depth: int = 3, min_split: int = 2) -> Boosted:
    """Boosting of a label that is positive above 0.5. The loss is looked at every ten rounds, and enough below 1e-4;
    scores are written down then, so that no expression holds more than ten trees."""
    rows = _rows(df, features, label, None)
    rows = rows.select("x", (F.col("y") > 0.5).cast("double").alias("label")).persist()
    try:
        n, positive = rows.agg(F.count("*"), F.sum("label")).first()
        if not n:
            raise ValueError("there are no rows to fit on")
        model = Boosted(math.log(max(positive / (n - positive + 1e-10), 1e-300)), rate)
        cuts = _cuts(rows)
        scored, since = rows.withColumn("score", F.lit(model.start)), []
        for i in range(rounds):
            now = F.col("score")
            for t in since:
                now = now + rate * t.column(F.col("x"))
            residual = scored.select("x", (F.col("label") - 1.0 / (1.0 + F.exp(-now))).alias("y"))
            tree = grow(residual, Criterion("mse"), [F.lit(1.0)], cuts, max_depth, min_split)[0]
            model.trees.append(tree)
            since.append(tree)
            if (i + 1) % LOSS_EVERY == 0:
                scored, since = checkpointed(scored.select("x", "label", (now + rate * tree.column(F.col("x"))).alias("score"))), []
                p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), 1.0 / (1.0 + F.exp(-F.col("score")))))
                loss = scored.agg(-F.avg(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))).first()[0]
                if loss < LOSS_ENOUGH:
                    break
        return model
    finally:
        rows.unpersist()

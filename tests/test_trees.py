"""Exact trees, forests, boosting and the network."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.operators import network, trees

ROWS = "k long, x array<double>, y double"
TWO = [(i, [v, v], float(v > 4)) for i, v in enumerate([1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 5.5, 6.0, 6.5, 7.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def gini(y):
    return 1 - sum((y.count(c) / len(y)) ** 2 for c in set(y))


def mse(y):
    m = sum(y) / len(y)
    return sum((v - m) ** 2 for v in y) / len(y)


def grown(rows, impurity, value, depth, left=2):
    """The same tree, tried split by split."""
    y = [r[2] for r in rows]
    if depth == 0 or len(rows) < left or impurity(y) < 1e-7:
        return value(y)
    best = None
    for f in range(len(rows[0][1])):
        for t in sorted({r[1][f] for r in rows}):
            a, b = [r for r in rows if r[1][f] <= t], [r for r in rows if r[1][f] > t]
            if a and b:
                s = round((len(a) * impurity([r[2] for r in a]) + len(b) * impurity([r[2] for r in b])) / len(rows), 12)
                if best is None or s < best[0]:
                    best = (s, f, t, a, b)
    if best is None:
        return value(y)
    _, f, t, a, b = best
    return f, t, grown(a, impurity, value, depth - 1), grown(b, impurity, value, depth - 1)


def as_nested(tree, at=0):
    n = tree.nodes[at]
    return n.value if n.feature is None else (n.feature, n.threshold, as_nested(tree, n.left), as_nested(tree, n.right))


def majority(y):
    return max(sorted(set(y)), key=y.count)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_match_a_search_over_all_splits(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randrange(9)), rng.choice([0.0, 1.0]), round(rng.uniform(0, 5), 1)], float(rng.randrange(3))) for i in range(150)]
    assert as_nested(trees.fit_classifier(frame(spark, rows), "x", "y", max_depth=3)) == grown(rows, gini, majority, 3)
    reg = trees.fit_regressor(frame(spark, rows), "x", "y", max_depth=2)
    want = grown(rows, mse, lambda y: sum(y) / len(y), 2)

    def close(a, b):
        return math.isclose(a, b, abs_tol=1e-9) if isinstance(a, float) else a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3])

    assert close(as_nested(reg), want)


def test_importances_are_impurity_taken_away(spark):
    tree = trees.fit_classifier(frame(spark, [(i, [v, 0.0], float(v > 2)) for i, v in enumerate([1.0, 2.0, 3.0, 4.0])]), "x", "y")
    assert tree.importances(2) == [1.0, 0.0] and trees.Tree.from_json(tree.to_json()) == tree


def test_forest_boosting_and_network_on_the_separable_rows(spark):
    df = frame(spark, TWO)
    y = [r[2] for r in TWO]
    predicted = lambda m: [r[0] for r in df.orderBy("k").select(m.column(F.col("x"))).collect()]
    assert predicted(trees.fit_forest(df, "x", "y", "k", trees=3, max_depth=3, bootstrap=False)) == y
    drawn = predicted(trees.fit_forest(df, "x", "y", "k", trees=21, max_depth=3))
    assert sum(a == b for a, b in zip(drawn, y)) >= 8  # the rows at the gap may be missing in most samples
    boosted = trees.fit_boosted(df, "x", "y", rounds=11, max_depth=2)
    assert predicted(boosted) == y and len(boosted.trees) == 11 and abs(boosted.start) < 1e-9
    model = network.fit_network(df, "x", "y", (8,), rate=0.1, epochs=60)
    p = {r.k: r.probability for r in network.probabilities(model, df, "k", "x").collect()}
    assert [float(p[i] > 0.5) for i in range(len(y))] == y


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    net = network.Network([3, 4], "tanh")

    def loss():
        p = net.probability(x)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(x, y, 7)
    for i, w in enumerate(net.w):
        before = loss()
        w[0, 0] += 1e-6
        assert abs((loss() - before) / 1e-6 - g[2 * i][0, 0]) < 1e-4
        w[0, 0] -= 1e-6


def test_nulls_constants_and_empty_tables(spark):
    df = frame(spark, [(1, [None, 1.0], 0.0), (2, [2.0, 1.0], 1.0), (3, None, 1.0), (4, [2.0, 1.0], None)])
    assert as_nested(trees.fit_classifier(df, "x", "y")) == (0, 0.0, 0.0, 1.0)
    assert as_nested(trees.fit_classifier(frame(spark, [(1, [1.0], 1.0), (2, [1.0], 0.0)]), "x", "y")) == 0.0
    with pytest.raises(ValueError):
        trees.fit_classifier(frame(spark, []), "x", "y")


def test_poisson_copies_have_mean_and_variance_one(spark):
    got = spark.range(20_000).select(trees.poisson_copies("id", 3, 42).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(got[0] - 1) < 0.03 and abs(got[1] - 1) < 0.06


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_values_ruled_out_by_ranges_leave_the_same_trees(spark, monkeypatch, criterion):
    for name, value in {"FINE": 32, "POINTS": 64, "ROWS_A_RANGE": 5}.items():
        monkeypatch.setattr(trees.ranges, name, value)
    rng = random.Random(5)

    def row(i):
        y = rng.randrange(3)
        return i, [rng.choice([0.0, 0.0, rng.gauss(y, 2)]), float(rng.randrange(4)), None if i % 9 == 0 else round(rng.uniform(-1, 1), 2), 7.0], float(y)

    df = spark.createDataFrame([row(i) for i in range(600)], ROWS).repartition(5).persist()
    tried, scored = [], trees._scored
    monkeypatch.setattr(trees, "_scored", lambda left, *args: tried.append(left.count()) or scored(left, *args))
    fit = lambda: trees.fit_forest(df, "x", "y", "k", trees=2, criterion=criterion, max_depth=3, min_leaf=2)
    whole, all_tried = fit(), sum(tried)
    tried.clear()
    monkeypatch.setattr(trees, "DIRECT", 0)
    assert fit() == whole
    assert sum(tried) < all_tried / 2

"""Mixing sources to target weights."""

from __future__ import annotations

import random
from collections import Counter

from sentrymill.llm.mixture import Mixture

DOCS = "doc_id long, text string, source string, n_tokens string, copies string"
TARGETS = "source string, target_weight double, max_repeats int"


def mixture(spark, docs, targets):
    return Mixture(spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS), spark.createDataFrame(targets, TARGETS))


def corpus():
    rng = random.Random(8)
    docs = []
    for i in range(1200):
        source = rng.choice(["big"] * 8 + ["Mid-Size", " mid size", "MID_SIZE"] + ["tiny"] + [None])
        docs.append((i, "word " * min(4000, int(rng.lognormvariate(3, 1))), source))
    return docs + [(5000, None, "big"), (5001, "", "mid_size"), (5002, "  ", None)]


def test_shares_repeats_and_shortfall(spark):
    m = mixture(spark, corpus(), [("big", 0.4, 1), ("mid_size", 0.5, 3), ("tiny", 0.1, 1), ("none there", 0.0, 4), ("absent", 0.2, 2)])
    copies = {r.doc_id: r for r in m.copies().collect()}
    plan = {r.source: r for r in m.plan().collect()}
    shares = {r.source: r for r in m.shares().collect()}
    assert all(r.copies <= {"big": 1, "mid_size": 3, "tiny": 1}[r.source] for r in copies.values())
    for s, r in plan.items():
        assert all(int(r.expected) <= c.copies <= int(r.expected) + 1 for c in copies.values() if c.source == s)
        if r.expected and not shares[s].short:
            assert abs(shares[s].share_of_target_size - r.weight) < 0.02
    assert shares["tiny"].short and shares["tiny"].copies == shares["tiny"].documents and shares["absent"].short and shares["absent"].supplied == 0


def test_copies_are_floor_or_ceiling_and_sum_up(spark):
    m = mixture(spark, [(i, "same words here", "one") for i in range(1000)] + [(9000 + i, "same words here", "two") for i in range(500)], [("one", 0.5, 9), ("two", 0.5, 9)])
    got = Counter()
    for r in m.copies().collect():
        got[r.source] += r.copies
    assert abs(got["one"] - 750) <= 1 and abs(got["two"] - 750) <= 1
    assert m.mix().count() == sum(got.values())
    assert [tuple(r) for r in m.limits().orderBy("source").collect()] == [("one", 1000, True, True), ("two", 500, True, True)]
    assert all(abs(r.relative_error) < 0.01 for r in m.shares().collect())
    assert m.mix().where("source = 'two'").groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 2


def test_runs_are_repeatable(spark):
    args = (corpus(), [("big", 0.3, 1), ("mid size", 0.7, 5)])
    assert sorted(map(tuple, mixture(spark, *args).mix().collect())) == sorted(map(tuple, mixture(spark, *args).mix().collect()))


def test_empty_corpus_and_empty_targets(spark):
    m = mixture(spark, [], [("big", 1.0, 2)])
    assert m.mix().count() == 0 and m.shares().first().supplied == 0
    assert mixture(spark, corpus()[:5], []).mix().count() == 0
    assert mixture(spark, [(1, None, "big")], [("big", None, None)]).mix().count() == 0

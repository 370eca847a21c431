"""Sample matching target category proportions."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrymill.llm.quota_sample import QuotaSample, need, quotas

ROWS = "record_id long, dataset_id int, label_family int, dataset_name string, key string, bucket string, row string"


def sampler(spark, rows, targets, **more):
    names = spark.createDataFrame([(0, "A"), (1, "B")], "dataset_id int, dataset_name string")
    return QuotaSample(spark.createDataFrame(rows, ROWS), names, spark.createDataFrame(targets, "dataset_name string, label_family int, target_share double, min_rows int"), **more)


def rows(counts):
    out, n = [], 0
    for (d, f), c in counts.items():
        out += [(n + i, d, f, "spelled badly", "clash", "b", "r") for i in range(c)]
        n += c
    return out


def test_needs_round_half_up_in_decimal():
    assert [need(0.005, 0, 100), need(0.015, 0, 100), need(0.285, 0, 100), need(0.0049, 0, 100), need(0.0, 3, 100), need(None, None, 100)] == [1, 2, 29, 0, 3, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 8), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
def test_quotas_keep_bounds_and_size(cells, size):
    shares, low, there = [c[0] / 100 for c in cells], [c[1] for c in cells], [c[2] for c in cells]
    got = quotas(shares, low, there, size)
    floor = [min(a, b) for a, b in zip(low, there, strict=True)]
    assert all(f <= q <= t for f, q, t in zip(floor, got, there, strict=True))
    reach = sum(t for t, s, f in zip(there, shares, floor, strict=True) if s > 0) + sum(f for f, s in zip(floor, shares, strict=True) if s == 0)
    assert sum(got) == max(sum(floor), min(size, reach))


def test_quotas_follow_shares_by_largest_remainder():
    assert quotas([0.5, 0.25, 0.25], [0, 0, 0], [100] * 3, 10) == [5, 3, 2]
    assert quotas([0.5, 0.5], [0, 0], [3, 100], 10) == [3, 7]
    assert quotas([0.98, 0.02], [0, 4], [100, 100], 10) == [6, 4]


def test_sample_has_the_quotas_and_is_stable(spark):
    data = rows({(0, 0): 3000, (0, 1): 40, (1, 0): 900, (1, 1): 1, (7, 0): 50, (0, None): 9})
    targets = [("A", 0, 0.5, 5), ("A", 1, 0.05, 30), ("B", 0, 0.4, 5), ("B", 1, 0.05, 3), ("C", 0, 0.0, 2)]
    s = sampler(spark, data, targets)
    first, again = s.sample().collect(), sampler(spark, data, targets).sample().collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len({r.record_id for r in first}) == len(first)
    quota = {(r.dataset_name, r.label_family): r.quota for r in s.report().collect()}
    got = Counter(("AB"[r.dataset_id], r.label_family) for r in first)
    assert got == Counter({k: v for k, v in quota.items() if v}) and len(first) == 400 and quota[("A", 1)] >= 30 and quota[("B", 1)] == 1
    assert {tuple(r)[3:] for r in first} == {("spelled badly", "clash", "b", "r")}
    assert {tuple(r) for r in s.unmet().collect()} == {("B", 1), ("C", 0)}


def test_smallest_keys_are_taken(spark):
    from hashlib import md5

    data = rows({(0, 0): 5000})
    s = sampler(spark, data, [("A", 0, 1.0, 0)])
    taken = {r.record_id for r in s.sample().collect()}
    order = sorted((md5(f"42:{r[0]}".encode()).hexdigest(), r[0]) for r in data)
    assert taken == {r for _, r in order[:500]}


def test_empty_tables(spark):
    s = sampler(spark, [], [("A", 0, 1.0, 2)])
    assert s.sample().count() == 0 and s.unmet().count() == 1
    assert sampler(spark, rows({(0, 0): 20}), []).sample().count() == 0


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_a_hot_cell(spark, hot):
    n = 4000
    data = rows({(0, 0): int(n * hot), (1, 0): n - int(n * hot)})
    s = sampler(spark, data, [("A", 0, 0.5, 0), ("B", 0, 0.5, 0)])
    assert Counter(r.dataset_id for r in s.sample().collect()) == Counter({0: 200, 1: 200})


def test_two_ids_with_one_name_are_one_source(spark):
    names = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "dataset_id int, dataset_name string")
    data = rows({(0, 0): 500, (1, 0): 500, (2, 0): 9000})
    s = QuotaSample(spark.createDataFrame(data, ROWS), names, spark.createDataFrame([("A", 0, 0.7, 0), ("B", 0, 0.3, 0)], "dataset_name string, label_family int, target_share double, min_rows int"))
    got = Counter(r.dataset_id for r in s.sample().collect())
    assert got[0] + got[1] == 700 and got[0] > 0 and got[1] > 0 and got[2] == 300 and s.unmet().count() == 0


def test_a_cell_listed_twice_counts_once(spark):
    s = sampler(spark, rows({(0, 0): 1000}), [("A", 0, 1.0, 0), ("A", 0, 1.0, 0)])
    assert s.report().count() == 1 and s.sample().count() == 100

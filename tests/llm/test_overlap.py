"""Same or near-same records across splits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.llm import overlap
from sentrymill.llm.overlap import MEASUREMENTS, overlaps, pairs

SCHEMA = "record_id long, split string, " + ", ".join(f"{m} double" for m in MEASUREMENTS)


def agree(a, b):
    if a is None or b is None:
        return a is None and b is None
    if not np.isfinite(a) or not np.isfinite(b):
        return False
    return abs(a - b) <= 0.01 * max(abs(a), abs(b))


def brute(rows):
    train, other = [r for r in rows if r[1] == "train"], [r for r in rows if r[1] in ("valid", "test")]
    return {
        (min(a[0], b[0]), max(a[0], b[0])) for a in train for b in other if sum(agree(x, y) for x, y in zip(a[2:], b[2:], strict=True)) >= 13
    }


def found(spark, rows, **more):
    return {tuple(r) for r in pairs(overlaps(spark.createDataFrame(rows, SCHEMA), **more)).collect()}


def near_copies(rng, n):
    """Records with copies whose values are moved to just inside or outside the tolerance, set null, zero or to another sign."""
    rows = []
    for i in range(n):
        base = [rng.choice([None, 0.0, -1.0, rng.uniform(-5, 5), rng.lognormvariate(3, 3), rng.lognormvariate(3, 3), float(rng.randrange(3))]) for _ in MEASUREMENTS]
        rows.append((10 * i, "train", *base))
        for c in range(4):
            changed = list(base)
            for j in rng.sample(range(16), rng.choice([0, 0, 1, 2, 3, 5])):
                changed[j] = rng.choice([None, 0.0, -(changed[j] or 1.0), rng.uniform(1, 9), float("nan"), float("inf")])
            moved = [None if v is None else v * rng.choice([1, 1, 1, 0.99, 0.9901, 1.00999, 1 / 0.9901, 0.995, 0.9899, 1.0103]) for v in changed]
            rows.append((10 * i + c + 1, rng.choice(["valid", "test", "train", "other", None]), *moved))
    return rows


@pytest.mark.parametrize("cell_width", [0.1, 0.025])
def test_random_near_copies_match_brute_force(spark, cell_width):
    rows = near_copies(random.Random(2), 150)
    expected = brute(rows)
    assert len(expected) > 60
    assert found(spark, rows, cell_width=cell_width) == expected


def test_every_place_of_three_differences_is_found(spark):
    base = [float(3 + 7 * j) for j in range(16)]
    rows, n = [(0, "train", *base)], 1
    for a in range(16):
        for b in range(a + 1, 16):
            for c in range(b + 1, 16):
                rows.append((n, "test", *[v * 5 if j in (a, b, c) else v * (1.0099 if j % 2 else 0.991) for j, v in enumerate(base)]))
                n += 1
    assert len(found(spark, rows)) == n - 1


def test_chains_cover_the_runs_of_a_pair_and_chance_seeds_end_early(spark):
    base = [float(3 + 7 * j) for j in range(16)]
    rows = [(1, "train", *base), (2, "test", *base), (3, "test", *[v * 5 if j in (0, 5, 10) else v for j, v in enumerate(base)]), (4, "test", *base[:5], *[v * 9 for v in base[5:]])]
    got = {r.held_out_id: r for r in overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {2, 3} and got[2].chained == 16 and 4 <= got[3].chained <= 13 and got[3].agreeing == 13 and got[3].seeds < got[2].seeds


def test_coverage_of_each_record(spark):
    base = [float(3 + 7 * j) for j in range(16)]
    rows = [(1, "train", *base), (2, "train", *base), (3, "test", *[v * 5 if j < 2 else v for j, v in enumerate(base)]), (4, "valid", *[v * 99 for v in base])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.when(F.col("record_id") == 2, "b").otherwise("a"))
    got = {tuple(r) for r in overlap.coverage(df, overlaps(df), "source").collect()}
    assert got == {(3, "test", "a", "a", 1, 0.875), (3, "test", "a", "b", 1, 0.875)}


def test_empty_sides_null_ids_and_null_records(spark):
    nothing = [None] * 16
    assert found(spark, []) == set()
    assert found(spark, [(1, "train", *nothing)]) == set()
    rows = [(1, "train", *nothing), (2, "test", *nothing), (None, "test", *nothing), (3, "valid", *nothing[:13], 1.0, 1.0, 1.0), (4, "valid", *nothing[:12], 1.0, 1.0, 1.0, 1.0)]
    assert found(spark, rows) == {(1, 2), (1, 3)}


def test_many_copies_of_one_record(spark):
    rows = [(i, "train" if i % 3 else "test", *map(float, range(16))) for i in range(90)]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 60 * 30


def test_clashing_columns_and_integer_measurements(spark):
    rows = [(1, "train", *map(float, range(16))), (2, "test", *map(float, range(16)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(7), "gram": F.lit(1), "seeds": F.lit(2), "fwd_packets": F.col("fwd_packets").cast("long")})
    assert [tuple(r) for r in pairs(overlaps(df)).collect()] == [(1, 2)]


def test_report_counts_records_once(spark):
    rows = [(1, "train", *map(float, range(16))), (2, "train", *map(float, range(16))), (3, "test", *map(float, range(16))), (4, "test", *[float(99 + i) for i in range(16)])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s"))
    (r,) = overlap.report(df, overlaps(df), "source").collect()
    assert (r.split, r.source, r.records, r.overlapping, r.pairs, r.mean_coverage) == ("test", "s", 2, 1, 2, 1.0)


def test_too_wide_a_definition_is_refused(spark):
    with pytest.raises(ValueError):
        overlaps(spark.createDataFrame([], SCHEMA), least=11)

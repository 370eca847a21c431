"""Messages delivered more than once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sentrymill.operators.redelivery import SeenRanges, accept_once, deduplicated, merged_ranges, repeats
from sentrymill.streaming.pipelines import DeliveryLedger

SCHEMA = "delivery_id long, id string, timestamp timestamp_ntz, received_at timestamp_ntz, kept string"
ORDER = ["timestamp", "received_at"]
T = datetime(2025, 1, 1)


def brute(rows):
    best = {}
    for d, i, t, r, _ in rows:
        if i is not None:
            k = i.strip(" ").lower()
            o = (t is None, t or T, r is None, r or T, d)
            best.setdefault(k, []).append((o, d))
    return {d for v in best.values() for o, d in sorted(v)[1:]}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {r.delivery_id for r in repeats(df, ORDER).collect()}


def test_random_deliveries_match_brute_force(spark):
    rng = random.Random(5)
    ids = [None, "", " ", "a-1", "A-1 ", "a-2", "a-007", "msg_ff", "MSG_FF", "é-1", "p:99999999999999999999"] + [f"n-{i}" for i in range(5)]
    rows = [
        (d, rng.choice(ids), rng.choice([None, T + timedelta(seconds=rng.randrange(4))]), rng.choice([None, T + timedelta(seconds=rng.randrange(3))]), "x")
        for d in range(400)
    ]
    assert found(frame(spark, rows)) == brute(rows)


def test_nulls_come_last_and_ties_go_to_the_smallest_delivery(spark):
    rows = [(3, "k", None, T, None), (2, "k", T, None, None), (1, "k", T, T, None), (0, "k", T, T, None), (9, None, T, T, None)]
    assert found(frame(spark, rows)) == {1, 2, 3}


def test_empty_table_and_null_ids(spark):
    assert found(frame(spark, [])) == set()
    df = frame(spark, [(1, None, None, None, None), (2, None, None, None, None)])
    assert found(df) == set()
    assert deduplicated(df, ORDER).count() == 2


def test_one_identifier_with_most_rows_leaves_one(spark):
    df = frame(spark, [(d, "hot-1" if d % 3 else f"x-{d}", T, T, None) for d in range(3000)])
    kept = deduplicated(df, ORDER)
    assert kept.where("id = 'hot-1'").count() == 1 and kept.count() == 1001


def test_ranges_stay_disjoint_and_maximal_across_blocks(spark):
    seqs = [*range(65_530, 65_545), 3, 4, 4, 10, 131_072, 131_071]
    df = frame(spark, [(i, f"node-{n}", T, T, None) for i, n in enumerate(seqs)])
    got = {(r.producer, r.lo, r.hi) for r in accept_once(df, ORDER).ranges.collect()}
    assert got == {("node-", 3, 4), ("node-", 10, 10), ("node-", 65_530, 65_544), ("node-", 131_071, 131_072)}


def test_batches_accept_each_number_once(spark):
    rng = random.Random(7)
    ids = [f"a-{rng.randrange(60)}" for _ in range(90)] + [f"a-0{rng.randrange(9)}" for _ in range(30)] + [f"B-{2**40 + rng.randrange(20)}" for _ in range(30)]
    rng.shuffle(ids)
    ranges = keys = None
    accepted = []
    for b in range(3):
        df = frame(spark, [(b * 50 + i, x, T, T, None) for i, x in enumerate(ids[b * 50 : b * 50 + 50])])
        done = accept_once(df, ORDER, ranges=ranges, keys=keys)
        accepted += [r.key for r in done.kept.collect()]
        # the state as it would be read back
        ranges = spark.createDataFrame(done.ranges.collect(), "producer string, lo bigint, hi bigint")
        keys = spark.createDataFrame(done.keys.collect(), "key string")
    assert sorted(accepted) == sorted({x.lower() for x in ids})
    again = merged_ranges(ranges)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in ranges.collect()}


def test_large_numbers_keep_their_precision(spark):
    big = 10**17 + 1
    df = frame(spark, [(1, f"p-{big}", T, T, None), (2, f"p-{big + 1}", T, T, None), (3, f"p-{big + 3}", T, T, None)])
    got = {(r.lo, r.hi) for r in accept_once(df, ORDER).ranges.collect()}
    assert got == {(big, big + 1), (big + 3, big + 3)}


def test_columns_with_clashing_names_are_ignored(spark):
    df = frame(spark, [(1, "a", T, T, None), (2, "a", T, T, None)]).withColumns({"key": F.lit("x"), "first": F.lit(1), "seq": F.lit(2), "producer": F.lit(3)})
    assert found(df) == {2}


def test_seen_ranges_match_a_set():
    rng = random.Random(3)
    for span in (12, 200):
        seen, covered = SeenRanges(), set()
        for _ in range(300):
            lo = rng.randrange(span)
            hi = lo + rng.choice((0, 0, 0, rng.randrange(6)))
            new = not set(range(lo, hi + 1)) <= covered
            assert seen.add(lo, hi) == new
            covered |= set(range(lo, hi + 1))
            assert [n for a, b in zip(seen.lo, seen.hi) for n in range(a, b + 1)] == sorted(covered)
            assert all(b + 1 < a for b, a in zip(seen.hi, seen.lo[1:]))


def test_sequences_are_decided_by_ranges_and_uuids_by_lookup(spark):
    df = frame(spark, [(1, "p-5", T, T, None), (2, "p-5", T, T, None), (3, "45eb5a58-0000-4000-8000-366718676127", T, T, None)])
    done = accept_once(df, ORDER)
    assert {(r.key, r.kept_id, r.seq) for r in done.kept.collect()} == {("p-5", 1, 5), ("45eb5a58-0000-4000-8000-366718676127", 3, None)}
    assert [tuple(r) for r in done.ranges.collect()] == [("p-", 5, 5)] and [r.key for r in done.keys.collect()] == ["45eb5a58-0000-4000-8000-366718676127"]
    assert "MapInArrow" in repeats(df, ORDER)._jdf.queryExecution().executedPlan().toString()


def test_many_batches_add_to_the_ledger_and_never_rewrite_it(spark, tmp_path):
    rng = random.Random(11)
    ledger, offered, written = DeliveryLedger(str(tmp_path), ORDER), [], {}
    for b in range(25):
        rows = [(b * 20 + i, rng.choice([f"p-{65_530 + rng.randrange(40)}", f"q-{rng.randrange(9)}", f"x{rng.randrange(30)}"]), T, T, None) for i in range(20)]
        offered += rows
        ledger(frame(spark, rows), b)
        for f in tmp_path.rglob("*.parquet"):
            assert written.setdefault(f, f.stat().st_mtime_ns) == f.stat().st_mtime_ns
    kept = {r.kept_id for r in ledger.accepted(spark).collect()}
    assert {r[0] for r in offered} - kept == brute(offered)  # all times are equal, so the first batch wins
    numbers = sorted({int(r[1][2:]) for r in offered if r[1].startswith("p-")})
    assert [n for r in ledger.ranges(spark).where("producer = 'p-'").orderBy("lo").collect() for n in range(r.lo, r.hi + 1)] == numbers

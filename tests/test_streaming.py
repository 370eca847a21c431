"""Streams give what their batch twins give, over several micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import state
from sentrymill.operators.redelivery import normalized_id
from sentrymill.streaming import pipelines as sp

T = datetime(2025, 1, 1)
SCHEMA = "o long, k string, id string, ts timestamp, score double"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = random.Random(11)
    data, t = [], 0
    for i in range(240):
        t += rng.randrange(1, 20)
        data.append((i, rng.choice("abc"), f"{rng.choice('PQ')}-{rng.randrange(60)}", T + timedelta(seconds=t), round(rng.random(), 2)))
    folder = str(tmp_path_factory.mktemp("stream"))
    for n in range(4):  # files in order of time, as one micro-batch each
        spark.createDataFrame(data[n * 60 : n * 60 + 60], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(data, SCHEMA), folder


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sp.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, folder):
    return sp.from_files(spark, folder, SCHEMA)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_response(spark, rows, rocksdb, tmp_path):
    batch, folder = rows
    out = sp.run_once(sp.response_tiers(stream(spark, folder), "k", "ts", "score", "o"), str(tmp_path))
    same(out, state.response_tiers(batch, "k", "ts", "score", "o"))


def test_rate_limit(spark, rows, rocksdb, tmp_path):
    batch, folder = rows
    out = sp.run_once(sp.rate_limited(stream(spark, folder), "k", "ts", "o", 3, 60_000_000), str(tmp_path))
    same(out, state.rate_limited(batch, "k", "ts", "o", 3, 60_000_000))


def test_ledger(spark, rows, tmp_path):
    batch, folder = rows
    ledger = sp.DeliveryLedger(str(tmp_path), ["ts"], "id", "o")
    sp.run_batches(stream(spark, folder), str(tmp_path), ledger)
    same(ledger.accepted(spark).select("key"), batch.select(normalized_id(F.col("id")).alias("key")).distinct())


def test_sessions_and_counters(spark, rows, tmp_path):
    batch, folder = rows
    timed = sp.with_event_time(stream(spark, folder), "ts", "10 days")
    seen = []
    sp.run_batches(sp.sessions(timed, "k", "ts", "30 seconds"), str(tmp_path / "a"), lambda df, i: seen.append(df.collect()), "complete")
    expected = batch.groupBy("k", F.session_window("ts", "30 seconds").alias("w")).agg(F.count("*").alias("packets")).select("k", F.unix_micros("w.start").alias("start_us"), "packets")
    assert sorted(map(tuple, seen[-1])) == sorted(map(tuple, expected.collect()))
    seen.clear()
    sp.run_batches(sp.counters(stream(spark, folder), "score"), str(tmp_path / "b"), lambda df, i: seen.append(df.first()), "complete")
    assert seen[-1].flows == 240 and seen[-1].threats == batch.where("score >= 0.4").count()


def test_last_rows(spark, rows, tmp_path):
    batch, folder = rows
    keep = sp.LastRows(str(tmp_path), ["ts", "o"], 7)
    n = []
    sp.run_batches(stream(spark, folder), str(tmp_path / "c"), lambda df, i: (keep(df, i), n.append(i)))
    same(spark.read.parquet(f"{tmp_path}/{max(n)}").select("o"), batch.orderBy(F.desc("ts"), F.desc("o")).limit(7))


PACKETS = "seq long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, flags int, win int"


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    rng, data, t = random.Random(4), [], 0
    for i in range(160):
        t += rng.choice([1, 2, 9])
        a, b = rng.choice([("10.0.0.1", "9.9.9.9"), ("9.9.9.9", "10.0.0.1"), ("10.0.0.2", "9.9.9.9")])
        data.append((i, T + timedelta(seconds=t), a, b, 5 if a[0] == "1" else 443, 443 if a[0] == "1" else 5, 6, rng.randrange(90), rng.choice([16, 16, 16, 16, 17, 4]), 0))
    data.append((999, T + timedelta(days=2), "10.0.0.9", "9.9.9.9", 5, 443, 17, 1, 0, 0))
    folder = str(tmp_path_factory.mktemp("packets"))
    for n in range(3):
        spark.createDataFrame(data[n * 54 : n * 54 + 54], PACKETS).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(data, PACKETS), folder


def test_flows_close_as_in_batch(spark, packets, rocksdb, tmp_path):
    from sentrymill.operators import flows as fl

    batch, folder = packets
    live = sp.with_event_time(sp.from_files(spark, folder, PACKETS), "ts", "1 second")
    out = sp.run_once(sp.flows(live, 8), str(tmp_path))
    whole = fl.flow_table(batch, 8).where("src_ip <> '10.0.0.9'")
    same(out.select("pair", "start_us", "last_us", "packets", "fwd_packets", "close_reason"), whole.select("pair", "start_us", "last_us", F.col("n_all").alias("packets"), F.col("n_fwd").alias("fwd_packets"), "close_reason"))


def test_flows_in_arrival_order_take_late_packets(spark, rocksdb, tmp_path):
    rows = [(1, T + timedelta(seconds=5), "a", "b", 1, 2, 6, 7, 16, 0), (2, T, "b", "a", 2, 1, 6, 5, 16, 0), (3, T + timedelta(seconds=6), "a", "b", 1, 2, 6, 1, 17, 0)]
    spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = sp.with_event_time(sp.from_files(spark, f"{tmp_path}/in", PACKETS), "ts", "1 second")
    (r,) = sp.run_once(sp.flows(live, 30, arrival=True), f"{tmp_path}/run").collect()
    us = int(T.timestamp() * 1e6)
    assert (r.packets, r.bytes, r.fwd_packets, r.close_reason, r.start_us - us, r.last_us - us) == (3, 13, 2, "fin_rst", 5_000_000, 6_000_000)


def test_unblocked_by_hand_and_switched_off(spark, rows, rocksdb, tmp_path):
    batch, folder = rows
    us = int(T.timestamp() * 1e6)
    unblocks = [("a", us + 400_000_000), ("b", us + 900_000_000), ("c", us + 10), (None, us)]
    toggles = spark.createDataFrame([(us + 600_000_000, False), (us + 1_200_000_000, True)], "us long, on boolean")
    by_hand = spark.createDataFrame(unblocks, "k string, us long")
    log = state.response_tiers(batch, "k", "ts", "score", "o", unblocks=by_hand, toggles=toggles)
    actions = {r.action for r in log.collect()}
    assert "UNBLOCKED" in actions and log.where(f"us > {us + 600_000_000} AND us < {us + 1_200_000_000} AND score > 0").count() == 0
    by_hand.coalesce(1).write.parquet(f"{tmp_path}/by_hand")
    live = sp.from_files(spark, f"{tmp_path}/by_hand", "k string, us long")
    whole = spark.createDataFrame(batch.collect(), SCHEMA).coalesce(1)
    whole.write.parquet(f"{tmp_path}/scores")  # one batch, so that both streams are read in order of time
    out = sp.run_once(sp.response_tiers(sp.from_files(spark, f"{tmp_path}/scores", SCHEMA), "k", "ts", "score", "o", unblocks=live, toggles=toggles), f"{tmp_path}/run")
    same(out, log)


def test_polled_by_the_clock(spark, rows, tmp_path):
    seen = []
    sp.run_polled(stream(spark, rows[1]), str(tmp_path), lambda df, i: seen.append(df.count()), 0.2, 6)
    assert sum(seen) == 240


def test_callables_get_what_closes_and_their_own_keys(spark, packets, rows, rocksdb, tmp_path):
    closed = []
    live = sp.with_event_time(sp.from_files(spark, packets[1], PACKETS), "ts", "1 second")
    sp.on_flow_closed(live, 8, lambda flows, batch: closed.append(flows.count()), str(tmp_path / "a"))
    assert sum(closed) > 10
    got = {"a": 0, "b": 0}
    calls = sp.Callbacks("k")
    for name in got:
        calls.subscribe(name, lambda df, batch, name=name: got.__setitem__(name, got[name] + df.count()))
    calls.unsubscribe("b")
    sp.run_batches(stream(spark, rows[1]), str(tmp_path / "b"), calls)
    assert got == {"a": rows[0].where("k = 'a'").count(), "b": 0}


def test_messages_are_kept_once_however_many_subscribe(spark, tmp_path, monkeypatch):
    from sentrymill.plans import stream_queries

    data = [(i, "ab"[i % 2], f"s{i % 8}") for i in range(40)] + [(40, "c", None), (41, None, "s1")]
    spark.createDataFrame(data, "delivery_id long, chat_id string, sender string").repartition(3).write.parquet(f"{tmp_path}/messages.parquet")
    kept, run_once = [], sp.run_once

    def watched(*args):
        kept.append(run_once(*args))
        return kept[-1]

    monkeypatch.setattr(sp, "run_once", watched)
    got = stream_queries.stream_subscribers(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a", 80, 4), ("b", 80, 4)]
    assert kept[0].count() == 40


def test_response_takes_files_that_are_not_in_order_of_time(spark, rows, tmp_path):
    from sentrymill.plans import stream_queries

    feed = rows[0].select(F.col("o").alias("feed_id"), F.col("k").alias("src_ip"), "ts", F.col("score").alias("malicious_probability"))
    for part in range(4):
        feed.where(F.col("feed_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed.parquet")
    got = stream_queries.stream_response(spark, str(tmp_path))
    same(got, state.response_tiers(feed, "src_ip", "ts", "malicious_probability", "feed_id", 6 * 3_600_000_000, 288 * state.BLOCK_US))


def test_files_published_are_no_more_than_places(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from sentrymill.plans import stream_queries

    data = [(i, f"chat-{i % 200}" if i % 200 else "", f"t {i}\n", f"s{i}") for i in range(1200)] + [(1200, None, "x", "s")]
    messages = spark.createDataFrame(data, "delivery_id long, chat_id string, text string, sender string")
    messages.repartition(3).write.parquet(f"{tmp_path}/messages.parquet")
    places, publish = [], sp.publish

    def watched(*args, **settings):
        places.append(publish(*args, **settings))
        return places[-1]

    monkeypatch.setattr(sp, "publish", watched)
    got = stream_queries.stream_publish(spark, str(tmp_path))
    same(got, messages.where("chat_id IS NOT NULL").select("chat_id", "delivery_id", F.length("text").alias("characters")))
    assert len(list(Path(places[0].removeprefix("file:")).rglob("*.json"))) <= stream_queries.PLACES
    own = spark.read.schema("delivery_id bigint, chat_id string").json(places[0]).where((F.col("place") == sp.place_of(F.lit("chat-7"), stream_queries.PLACES)) & (F.col("chat_id") == "chat-7"))
    assert own.count() == 6
    by_channel = publish(sp.from_files(spark, f"{tmp_path}/messages.parquet", messages.schema, None).where("chat_id LIKE 'chat-1_'"), "chat_id", str(tmp_path / "each"))
    assert len(list(Path(by_channel).glob("chat_id=*/*.json"))) == 10 and spark.read.json(by_channel).count() == 60

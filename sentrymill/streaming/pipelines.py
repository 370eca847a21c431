"""Structured Streaming counterparts: the same transitions and columns as in batch, over unbounded input.

Event-time operators take a watermark and need ``timestamp`` columns (``with_event_time`` converts).
State is kept by Spark: session windows and deduplication by the built-in operators, state machines by
``transformWithStateInPandas`` with the transition functions of ``sentrymill.operators.state``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sentrymill.operators import state
from sentrymill.operators.flows import FIN, RST, TCP, with_pair
from sentrymill.operators.redelivery import KEY_SCHEMA, RANGE_SCHEMA, accept_once, merged_ranges

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def from_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = 1, bytes_per_batch: int | None = None) -> DataFrame:
    """Files of a folder in micro-batches of so many files, or of so many bytes if those are given; without either, all that is there is one micro-batch."""
    reader = spark.readStream.schema(schema)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    elif files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Casts the time to ``timestamp``, which watermarks require, and sets the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def sessions(packets: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Idle-gap sessions; needs a watermark."""
    return packets.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("packets")).select(
        key, F.unix_micros("w.start").alias("start_us"), "packets"
    )


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the events with equal keys within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, length: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """Rows and sum per sliding window and keys."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.unix_micros("w.start").alias("start_us"), *keys, "n", "total"
    )


def counters(scored: DataFrame, score: str, limit: float = 0.40) -> DataFrame:
    """Running totals, for complete output mode."""
    return scored.agg(F.count("*").alias("flows"), F.count_if(F.col(score) >= limit).alias("threats"))


def of_channels(published: DataFrame, channels: list[str]) -> DataFrame:
    return published.where(F.col("channel").isin(*channels))


def for_subscribers(published: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join with (subscriber, channels array)."""
    return published.join(subscriptions.select("subscriber", F.explode("channels").alias("channel")), "channel")


def receivers(subscriptions: DataFrame) -> DataFrame:
    """(channel, copies, subscribers) of (subscriber, channels array): rows that ``for_subscribers`` makes of one row of the channel, and the different subscribers."""
    each = subscriptions.select("subscriber", F.explode("channels").alias("channel"))
    return each.groupBy("channel").agg(F.count("*").alias("copies"), F.count_distinct("subscriber").alias("subscribers"))


def with_receivers(published: DataFrame, receiving: DataFrame) -> DataFrame:
    """Stream-static join with ``receivers``: each row of a channel that has subscribers once, however many they are."""
    return published.join(receiving, "channel")


class TierProcessor(StatefulProcessor):
    """Response tiers of one source; its state is the transition's state as one JSON value."""

    COLUMNS = {"us": "Int64", "action": "object", "tier": "Int32", "score": "Float64", "hits": "Int32", "blocked_tier": "Int32"}

    def __init__(self, window_us: int, block_us: int):
        self.window_us, self.block_us = window_us, block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("tier", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.held.get()[0]) if self.held.exists() else None
        out = []
        us_of, o_of, score_of = (np.concatenate(c) for c in zip(*[[f[c].to_numpy() for c in ("us", "o", "score")] for f in rows]))
        order = np.lexsort((o_of, us_of))
        for us, score in zip(us_of[order].tolist(), score_of[order].tolist()):
            s, actions = state.control_transition(s, us) if score != score else state.tier_transition(s, us, score, self.window_us, self.block_us)  # no score: unblocked by hand
            out += actions
        self.held.update((json.dumps(s),))
        if out:
            yield pd.DataFrame({"k": key[0]} | {n: pd.array(c, dtype=kind) for (n, kind), c in zip(self.COLUMNS.items(), zip(*out))})

    def close(self) -> None:
        pass


class LimitProcessor(StatefulProcessor):
    """Anchored rate limit of one device."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("limit", "anchor bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.held.get()) if self.held.exists() else None
        out = []
        whole = pd.concat(list(rows)).sort_values(["us", "o"])
        for us, o in zip(whole["us"].tolist(), whole["o"].tolist()):
            s, ok = state.limit_transition(s, us, self.limit, self.window_us)
            out.append((key[0], o, ok))
        self.held.update(s)
        yield pd.DataFrame(out, columns=["k", "o", "allowed"])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, key: str, ts: str, order: str, *more: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).cast("bigint").alias("o"), *more
    )


def response_tiers(scored: DataFrame, key: str, ts: str, score: str, order: str, window_us: int = state.WINDOW_US, block_us: int = state.BLOCK_US, unblocks: DataFrame | None = None, toggles: DataFrame | None = None) -> DataFrame:
    """As in batch; ``unblocks`` (k, us) is a stream like the scores, ``toggles`` a small table."""
    rows = _keyed(scored.where(~F.col(key).isin(*state.NEVER_BLOCKED, "?", "") & F.col(score).isNotNull()), key, ts, order, F.col(score).cast("double").alias("score"))
    if toggles is not None:
        rows = rows.where(state.switched_on(F.col("us"), toggles))
    if unblocks is not None:
        rows = rows.unionByName(unblocks.where("k IS NOT NULL AND us IS NOT NULL").select("k", "us", F.lit(-1).cast("bigint").alias("o"), F.lit(None).cast("double").alias("score")))
    out = rows.groupBy("k").transformWithStateInPandas(TierProcessor(window_us, block_us), f"k string, {state.TIER_SCHEMA}", "Append", "None")
    return out.withColumnRenamed("k", key)


def rate_limited(events: DataFrame, key: str, ts: str, order: str, limit: int, window_us: int) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    out = _keyed(events, key, ts, order).groupBy("k").transformWithStateInPandas(LimitProcessor(limit, window_us), f"k {kind}, o bigint, allowed boolean", "Append", "None")
    return out.withColumnsRenamed({"k": key, "o": order})


FLOW_SCHEMA = "start_us bigint, last_us bigint, packets bigint, bytes bigint, fwd_packets bigint, close_reason string"


class FlowProcessor(StatefulProcessor):
    """The open flow of one pair of endpoints.

    ``wall`` false: a packet more than the gap after the last one closes the flow before it, and a flow without
    packets is closed when the watermark has passed its end by the gap. ``wall`` true: idle flows are looked for every
    ``tick_s`` seconds by the clock and at no other time, so that a late packet may still extend one. Packets are
    taken in order of time within a batch, or, with ``arrival``, as they came; the last one to arrive then sets the
    time of the flow, and late ones are appended.
    """

    def __init__(self, gap_us: int, wall: bool, tick_s: int, arrival: bool):
        self.gap_us, self.wall, self.tick_s, self.arrival = gap_us, wall, tick_s, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("flow", "state string")

    def _out(self, key, closed: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *c) for c in closed], columns=["pair", "start_us", "last_us", "packets", "bytes", "fwd_packets", "close_reason"])
        return frame.astype({c: "Int64" for c in ("start_us", "last_us", "packets", "bytes", "fwd_packets")})

    @staticmethod
    def _closed(s: dict, reason: str) -> tuple:
        return s["start"], s["last"], s["n"], s["bytes"], s["fwd"], reason

    def _wait(self, timer_values, s: dict) -> None:
        if self.wall:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.tick_s * 1_000)
        else:
            self.handle.registerTimer((s["last"] + self.gap_us) // 1_000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.held.get()[0]) if self.held.exists() else None
        begun, closed = s is not None, []
        whole = pd.concat(list(rows)).sort_values(["o"] if self.arrival else ["us", "o"])
        for us, source, length, ends in zip(whole["us"].tolist(), whole["source"].tolist(), whole["length"].tolist(), whole["ends"].tolist()):
            if s and not self.wall and us - s["last"] > self.gap_us:
                closed.append(self._closed(s, "idle"))
                s = None
            s = s or {"start": us, "source": source, "n": 0, "bytes": 0, "fwd": 0}
            s |= {"last": us, "n": s["n"] + 1, "bytes": s["bytes"] + int(length), "fwd": s["fwd"] + (source == s["source"])}
            if ends:
                closed.append(self._closed(s, "fin_rst"))
                s = None
        if s:
            self.held.update((json.dumps(s),))
            if not (self.wall and begun):
                self._wait(timerValues, s)
        elif begun:
            self.held.clear()
        yield self._out(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = json.loads(self.held.get()[0]) if self.held.exists() else None
        if s:
            now_us = (timerValues.getCurrentProcessingTimeInMs() if self.wall else timerValues.getCurrentWatermarkInMs()) * 1_000
            if now_us - s["last"] > self.gap_us:
                self.held.clear()
                yield self._out(key, [self._closed(s, "idle")])
            else:
                self._wait(timerValues, s)

    def close(self) -> None:
        pass


def flows(packets: DataFrame, gap_s: float, wall: bool = False, tick_s: int = 5, arrival: bool = False) -> DataFrame:
    """(pair, times, packets, bytes, forward packets, close reason) of each flow when it closes; packets need an event time unless ``wall``."""
    ends = (F.col("protocol") == TCP) & (F.col("flags").bitwiseAND(FIN | RST) != 0)
    rows = with_pair(packets).select(
        "ts", "pair", F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("o"), F.concat_ws(":", "src_ip", "src_port").alias("source"), F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), F.coalesce(ends, F.lit(False)).alias("ends"),
    )
    processor = FlowProcessor(int(gap_s * 1_000_000), wall, tick_s, arrival)
    return rows.groupBy("pair").transformWithStateInPandas(processor, f"pair string, {FLOW_SCHEMA}", "Append", "ProcessingTime" if wall else "EventTime")


class DeliveryLedger:
    """Accepts each message once over micro-batches; seen ranges and malformed keys stand in a folder that is only appended to.

    A batch adds the ranges of the blocks it touched and its new keys, and reads those of the batches before it;
    what is there is never written again. A batch that runs again after a failure overwrites its own part and reads
    the same ones before, so the result is the same.
    """

    def __init__(self, folder: str, order: list[str], message_id: str = "id", delivery_id: str = "delivery_id"):
        self.folder, self.order, self.message_id, self.delivery_id = folder, order, message_id, delivery_id

    def _state(self, spark: SparkSession, batch: int) -> tuple[DataFrame | None, DataFrame | None]:
        if batch == 0:
            return None, None
        read = lambda name, schema: spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/{b}" for b in range(batch)])
        return read("ranges", RANGE_SCHEMA), read("keys", KEY_SCHEMA)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        ranges, keys = self._state(rows.sparkSession, batch)
        rows.persist()
        done = accept_once(rows, self.order, self.message_id, self.delivery_id, ranges, keys)
        done.block_ranges.write.mode("overwrite").parquet(f"{self.folder}/ranges/{batch}")
        done.new_keys.write.mode("overwrite").parquet(f"{self.folder}/keys/{batch}")
        done.kept.write.mode("overwrite").parquet(f"{self.folder}/accepted/{batch}")
        rows.unpersist()

    def accepted(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/accepted/*")

    def ranges(self, spark: SparkSession) -> DataFrame:
        """All ranges seen, disjoint and maximal."""
        return merged_ranges(spark.read.schema(RANGE_SCHEMA).parquet(f"{self.folder}/ranges/*"))


class Callbacks:
    """Callables by key of a stream: each gets the rows of its key in every batch that has some. For ``run_batches``.

    A callable is called with a DataFrame, so what it does with the rows is done where they are.
    """

    def __init__(self, key: str):
        self.key, self.calls = key, {}

    def subscribe(self, value, call) -> None:
        self.calls.setdefault(value, []).append(call)

    def unsubscribe(self, value) -> None:
        self.calls.pop(value, None)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if not self.calls:
            return
        rows.persist()
        try:
            for (value,) in rows.where(F.col(self.key).isin(*self.calls)).select(self.key).distinct().collect():  # at most one row per subscription
                for call in self.calls[value]:
                    call(rows.where(F.col(self.key) == value), batch)
        finally:
            rows.unpersist()


def on_flow_closed(packets: DataFrame, gap_s: float, call, folder: str, **settings) -> None:
    """Calls ``call(flows, batch)`` with the flows that each micro-batch closes."""
    run_batches(flows(packets, gap_s, **settings), folder, call)


class LastRows:
    """A sink that keeps the newest n rows of everything seen, as a versioned table."""

    def __init__(self, folder: str, order: list[str], n: int):
        self.folder, self.order, self.n = folder, order, n

    def __call__(self, rows: DataFrame, batch: int) -> None:
        whole = rows if batch == 0 else rows.unionByName(rows.sparkSession.read.parquet(f"{self.folder}/{batch - 1}"))
        whole.orderBy(*[F.desc(c) for c in self.order]).limit(self.n).write.mode("overwrite").parquet(f"{self.folder}/{batch}")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows, read again from the sink."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def place_of(channel: Column, places: int) -> Column:
    """The place of a channel where ``publish`` shares places."""
    return F.pmod(F.xxhash64(channel), F.lit(places)).cast("int")


def publish(stream: DataFrame, channel: str, folder: str, fmt: str = "json", places: int | None = None, **options) -> str:
    """Writes what arrives to a sink with one place per channel, each row once; returns the place. ``fmt`` is any sink format of the session that takes a path.

    With ``places`` the channels share so many by their hash (partition column ``place``) and rows keep their channel: for many channels, since
    a folder and a file each cost more than their rows. Rows of a place meet in one task, so that a micro-batch adds one file to it.
    """
    if places:
        stream = stream.withColumn("place", place_of(F.col(channel), places))
    by = "place" if places else channel
    writer = stream.repartition(by).writeStream.format(fmt).outputMode("append").partitionBy(by).options(**options)
    query = writer.option("path", f"{folder}/published").option("checkpointLocation", f"{folder}/published-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/published"


def run_batches(stream: DataFrame, folder: str, each, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def run_polled(stream: DataFrame, folder: str, each, seconds: float, polls_s: float, mode: str = "append") -> None:
    """Asks the source again every ``seconds`` by the clock, for ``polls_s`` in all."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=f"{seconds} seconds").start()
    try:
        query.awaitTermination(polls_s)
    finally:
        query.stop()

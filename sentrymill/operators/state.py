"""Per-key state machines as folds: response tiers, anchored rate limit, batches, versioned writes, one-time keys.

The transition functions are plain Python on (state, row) and are shared with the streaming operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.operators.fold import folded
from sentrymill.sources.tables import small_rows

# Tier scores, rolling window, hits that escalate, remembered hits, block time.
TIER_SCORES = (0.92, 0.80, 0.65)
WINDOW_US, ESCALATE_HITS, HISTORY, BLOCK_US = 60_000_000, 3, 50, 300_000_000
NEVER_BLOCKED = ("127.0.0.1", "::1")
TIER_SCHEMA = "us bigint, action string, tier int, score double, hits int, blocked_tier int"


def tier_transition(state: dict | None, us: int, score: float, window_us: int = WINDOW_US, block_us: int = BLOCK_US) -> tuple[dict, list[tuple]]:
    """Next state {history, tier, until} of a source and the actions taken on one score.

    A block that has run out is lifted first. A source in tier 1 is ignored. Every other score is
    remembered, however low. Scores of tier 1 block; tier 2 holds, and blocks from three hits in the
    window on; tier 3 tracks, and blocks likewise.
    """
    s = state or {"history": [], "tier": None, "until": None}
    out = []
    if s["tier"] is not None and s["until"] is not None and us >= s["until"]:
        out.append((s["until"], "UNBLOCK", s["tier"], None, 0, None))
        s = s | {"tier": None, "until": None}
    if s["tier"] == 1:
        return s, out
    history = (s["history"] + [us])[-HISTORY:]
    hits = sum(us - t <= window_us for t in history)
    s = s | {"history": history}
    block = lambda tier: s | {"tier": tier, "until": us + block_us}
    one, two, three = TIER_SCORES
    if score >= one:
        s = block(1)
        out.append((us, "T1_BLOCK", 1, score, hits, 1))
    elif score >= two:
        if s["tier"] is None:
            s = block(2)
        out.append((us, "T2_RESET", 2, score, hits, s["tier"]))
        if hits >= ESCALATE_HITS:
            s = block(1)
            out.append((us, "T1_ESCALATED", 1, score, hits, 1))
    elif score >= three:
        out.append((us, "T3_TRACK", 3, score, hits, s["tier"]))
        if hits >= ESCALATE_HITS:
            s = block(1)
            out.append((us, "T1_RATE", 1, score, hits, 1))
    return s, out


def control_transition(state: dict | None, us: int) -> tuple[dict | None, list[tuple]]:
    """A source unblocked by hand: a block that has run out is lifted as such, one in force is removed; what is remembered of the source stays."""
    if state is None or state["tier"] is None:
        return state, []
    over = state["until"] is not None and us >= state["until"]
    action = (state["until"], "UNBLOCK", state["tier"], None, 0, None) if over else (us, "UNBLOCKED", state["tier"], 0.0, 0, None)
    return state | {"tier": None, "until": None}, [action]


def switched_on(at: Column, toggles: DataFrame | None, bound: int = 10_000) -> Column:
    """Whether the engine is on at a time in microseconds: as the latest toggle (us, on) up to it says, on before the first. Toggles are few; more than ``bound`` raise."""
    if toggles is None:
        return F.lit(True)
    rows = sorted(small_rows(toggles.select("us", "on"), bound))
    if not rows:
        return F.lit(True)
    table = F.array(*[F.struct(F.lit(us).cast("bigint").alias("us"), F.lit(bool(on)).alias("on")) for us, on in rows])
    upto = F.filter(table, lambda t: t["us"] <= at)
    return F.coalesce(F.get(upto, F.size(upto) - 1)["on"], F.lit(True))


def response_tiers(scored: DataFrame, key: str, ts: str, score: str, order: str, window_us: int = WINDOW_US, block_us: int = BLOCK_US, unblocks: DataFrame | None = None, toggles: DataFrame | None = None) -> DataFrame:
    """Action log of every source: (key, us, action, tier, score, hits, blocked_tier); null and exempt sources take no part.

    ``unblocks`` (k, us) removes blocks by hand, before scores of the same time; while the engine is off by ``toggles``
    (us, on) scores are neither acted upon nor remembered.
    """
    rows = scored.where(F.col(key).isNotNull() & ~F.col(key).isin(*NEVER_BLOCKED, "?", "") & F.col(score).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(score).cast("double").alias("score"), F.col(order).cast("bigint").alias("o"))
    if toggles is not None:
        rows = rows.where(switched_on(F.col("us"), toggles))
    if unblocks is not None:
        rows = rows.unionByName(unblocks.where("k IS NOT NULL AND us IS NOT NULL").select("k", "us", F.lit(None).cast("double").alias("score"), F.lit(-1).cast("bigint").alias("o")))

    def step(state, row):
        if row["score"] is None:
            state, out = control_transition(state, row["us"])
            return state, [(row["k"], *x) for x in out]
        state, out = tier_transition(state, row["us"], row["score"], window_us, block_us)
        return state, [(row["k"], *x) for x in out]

    return folded(rows, ["k"], ["us", "o"], step, f"k string, {TIER_SCHEMA}").withColumnRenamed("k", key)


def limit_transition(state: tuple | None, us: int, limit: int, window_us: int) -> tuple[tuple, bool]:
    """State (anchor, count) of a device and whether the call is allowed; the window is anchored at its first call."""
    if state is None or us - state[0] > window_us:
        return (us, 1), True
    if state[1] >= limit:
        return state, False
    return (state[0], state[1] + 1), True


def rate_limited(events: DataFrame, key: str, ts: str, order: str, limit: int, window_us: int) -> DataFrame:
    """(order column, key, allowed) of every event."""
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).alias("o"))

    def step(state, row):
        state, ok = limit_transition(state, row["us"], limit, window_us)
        return state, [(row["o"], row["k"], ok)]

    kinds = rows.dtypes
    schema = f"o {kinds[2][1]}, k {kinds[0][1]}, allowed boolean"
    return folded(rows, ["k"], ["us", "o"], step, schema).withColumnsRenamed({"o": order, "k": key})


def batched(packets: DataFrame, lane: str, hop: str, ts: str, order: str, full: int, wait_us: int) -> DataFrame:
    """Batches of each lane: all its hops are flushed when one holds ``full`` packets or ``wait_us`` has passed
    since the last flush. (lane, flush, hop, packets, padding); what is left at the end is the last flush."""
    rows = packets.select(F.col(lane).alias("k"), F.col(hop).cast("string").alias("hop"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).alias("o"))

    def flush(key, s):
        return [(key, s["n"], h, c, max(0, full - c)) for h, c in sorted(s["held"].items(), key=lambda x: str(x[0]))]

    def step(s, row):
        s = s or {"n": 0, "held": {}, "last": row["us"]}
        out = []
        if s["held"] and row["us"] - s["last"] >= wait_us:
            out = flush(row["k"], s)
            s = {"n": s["n"] + 1, "held": {}, "last": row["us"]}
        held = s["held"] | {row["hop"]: s["held"].get(row["hop"], 0) + 1}
        s = s | {"held": held}
        if held[row["hop"]] >= full:
            out += flush(row["k"], s)
            s = {"n": s["n"] + 1, "held": {}, "last": row["us"]}
        return s, out

    kind = rows.dtypes[0][1]
    schema = f"k {kind}, flush int, hop string, packets int, padding int"
    return folded(rows, ["k"], ["us", "o"], step, schema, lambda s, key: flush(key[0], s)).withColumnsRenamed({"k": lane, "hop": hop})


def cas_replay(writes: DataFrame, key: str, order: str, expected: str, value: str) -> DataFrame:
    """(order column, key, applied, version after): a write applies if its expected version is the current one; null always applies."""
    rows = writes.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(expected).cast("bigint").alias("e"), F.col(value).cast("string").alias("v"))

    def step(version, row):
        version = version or 0
        ok = row["e"] is None or row["e"] == version
        version += ok
        return version, [(row["o"], row["k"], ok, version)]

    kinds = rows.dtypes
    schema = f"o {kinds[1][1]}, k {kinds[0][1]}, applied boolean, version bigint"
    return folded(rows, ["k"], ["o"], step, schema).withColumnsRenamed({"o": order, "k": key})


def consumed_keys(events: DataFrame, key: str, order: str, kind: str, item: str) -> DataFrame:
    """Last-in-first-out stock per key: ``add`` pushes the item, ``take`` pops the newest. (order, key, item taken, left)."""
    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(kind).alias("kind"), F.col(item).cast("string").alias("i"))

    def step(stock, row):
        stock = stock or []
        if row["kind"] == "add":
            return [*stock, row["i"]], []
        taken = stock[-1] if stock else None
        return stock[:-1], [(row["o"], row["k"], taken, max(0, len(stock) - 1))]

    kinds = rows.dtypes
    schema = f"o {kinds[1][1]}, k {kinds[0][1]}, taken string, left int"
    return folded(rows, ["k"], ["o"], step, schema).withColumnsRenamed({"o": order, "k": key})


def expired_blocks(blocks: DataFrame, ts: str, until: str, at) -> DataFrame:
    """Adds active: begun and not yet run out at the given time; a block without end stays."""
    return blocks.withColumn("active", (F.col(ts) <= at) & (F.col(until).isNull() | (F.col(until) > at)))


def adjusted_policy(score) -> dict:
    """Re-key seconds, padding rate and path length of the four score bands, as columns (fixed values)."""
    band = lambda a, b, c, d: F.when(score > 0.8, F.lit(a)).when(score > 0.6, F.lit(b)).when(score > 0.4, F.lit(c)).otherwise(F.lit(d))
    return {"rekey_s": band(60, 300, 3600, 7200), "padding_rate": band(0.9, 0.6, 0.3, 0.1), "path_length": band(5, 3, 2, 1)}


def padding_rates(scored: DataFrame, key: str, order: list[str], score: str, start: float = 0.2, budget: float = 1.0, most: float = 0.8) -> DataFrame:
    """Padding rate after each score: half more above 0.7 (0.9 at most), a fifth less below 0.3 while over 0.1, within the budget."""
    rows = scored.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(score).cast("double").alias("s"))

    def step(rate, row):
        rate = start if rate is None else rate
        if row["s"] is not None and row["s"] > 0.7:
            rate = min(rate * 1.5, 0.9)
        elif row["s"] is not None and row["s"] < 0.3 and rate > 0.1:
            rate *= 0.8
        if rate * budget > most:
            rate = most / budget
        return rate, [(row["k"], *[row[f"o{i}"] for i in range(len(order))], rate)]

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"k {kinds['k']}", *[f"o{i} {kinds[f'o{i}']}" for i in range(len(order))], "rate double"])
    return folded(rows, ["k"], [f"o{i}" for i in range(len(order))], step, schema).withColumnsRenamed({"k": key} | {f"o{i}": c for i, c in enumerate(order)})


def key_care(stocks: DataFrame, key: str, signed_at: str, left: str, now: Column, threshold: int = 10, max_age_s: int = 7 * 24 * 3_600) -> DataFrame:
    """(key, rotate, replenish): a signed key older than a week (strictly) or missing is due, a stock below the threshold or missing is to be filled."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(signed_at).cast("timestamp"))
    return stocks.select(key, F.coalesce(age > max_age_s, F.lit(True)).alias("rotate"), F.coalesce(F.col(left) < threshold, F.lit(True)).alias("replenish"))

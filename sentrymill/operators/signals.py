"""Link readings and event series: health, threat indicators, outliers, regularity, typing rhythm, audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.functions.stats import entropy_of, ladder, ratio
from sentrymill.operators.fold import folded
from sentrymill.sources.tables import bounded_broadcast

# Limits of a healthy link.
SNR_MIN, LATENCY_MAX, JITTER_MAX, LOSS_MAX = 10.0, 250.0, 30.0, 2.0

# Attack signatures (id, name, indicators, severity), in order of precedence.
SIGNATURES = (
    ("JAMMING-001", "Constant Jamming", ("snr_drop", "uniform_noise"), "critical"),
    ("JAMMING-002", "Reactive Jamming", ("burst_noise", "latency_spike"), "high"),
    ("SPOOF-001", "GPS Spoofing", ("timing_drift", "position_anomaly"), "critical"),
    ("SPOOF-002", "Identity Spoofing", ("replay_detected", "id_mismatch"), "critical"),
    ("INTRUDE-001", "Rogue Node Insertion", ("unknown_src", "key_mismatch"), "high"),
    ("INTRUDE-002", "Man-in-the-Middle", ("cert_anomaly", "timing_delta"), "critical"),
    ("INTRUDE-003", "Beaconing / C2 Channel", ("regular_iat", "small_payload"), "high"),
    ("DOS-001", "Denial of Service", ("packet_flood", "queue_saturation"), "critical"),
)


def health(readings: DataFrame) -> DataFrame:
    """Adds issues (array), health_score and status; a null measurement breaks no rule."""
    rules = (
        ("snr", F.col("snr_db") < SNR_MIN),
        ("latency", F.col("latency_ms") > LATENCY_MAX),
        ("jitter", F.col("jitter_ms") > JITTER_MAX),
        ("loss", F.col("packet_loss_pct") > LOSS_MAX),
    )
    issues = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    score = F.lit(1.0) - F.size("issues") / 4.0
    status = (
        F.when(F.col("health_score") == 1.0, "nominal").when(F.col("health_score") >= 0.75, "degraded").when(F.col("health_score") >= 0.5, "impaired").otherwise("critical")
    )
    return readings.withColumn("issues", issues).withColumn("health_score", score).withColumn("status", status)


def health_summary(judged: DataFrame) -> DataFrame:
    """One row: mean score, readings, and the count of each status, 0 where none."""
    states = ("nominal", "degraded", "impaired", "critical")
    return judged.agg(
        F.avg("health_score").alias("avg_score"), F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states]
    )


def indicators(readings: DataFrame) -> DataFrame:
    """Adds triggered indicators, threat_score, threat_class, matched signature ids and severity."""
    v = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    snr, loss, latency = v("snr_db", 30.0), v("packet_loss_pct", 0.0), v("latency_ms", 20.0)
    beacon = (v("iat_variance", 0.0) < 0.05) & (v("payload_size_bytes", 256.0) < 64)
    rules = (
        (snr < 5, 0.35, ("snr_drop",)),
        ((snr >= 5) & (snr < SNR_MIN), 0.15, ("snr_weak",)),
        (v("timing_drift_ms", 0.0) > 500, 0.25, ("timing_drift",)),
        (v("replay_flag", False), 0.30, ("replay_detected",)),
        ((loss > 10) & (latency > 300), 0.25, ("packet_flood",)),
        (beacon, 0.20, ("regular_iat", "small_payload")),
        (v("unique_src_count", 1) > 5, 0.15, ("unknown_src",)),
    )
    score = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w, _ in rules), F.lit(0.0))
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for c, _, names in rules for n in names]), lambda x: x.isNotNull())
    out = readings.withColumns({"threat_score": F.round(F.least(score, F.lit(1.0)), 4), "triggered": named})
    hit = lambda names: F.arrays_overlap(F.col("triggered"), F.array(*[F.lit(n) for n in names]))
    matched = F.filter(F.array(*[F.when(hit(i), F.struct(F.lit(s).alias("id"), F.lit(sev).alias("severity"))) for s, _, i, sev in SIGNATURES]), lambda x: x.isNotNull())
    s = F.col("threat_score")
    return out.withColumn("matched", matched).withColumns(
        {
            "threat_class": ladder(s, (0.15, "clean"), (0.35, "suspicious"), (0.60, "threat"), last="attack"),
            "signatures": F.transform("matched", lambda m: m["id"]),
            "severity": F.coalesce(F.get("matched", F.lit(0))["severity"], F.when(s > 0.5, "high").when(s > 0.25, "medium").otherwise("low")),
        }
    ).drop("matched")


def signature_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, list(ind), s) for i, n, ind, s in SIGNATURES], "id string, name string, indicators array<string>, severity string")


def signature_matches(events: DataFrame, key: str, signatures: DataFrame) -> DataFrame:
    """(key, signature id) of every overlap: an equi-join on the exploded indicators instead of a cross join."""
    one = events.select(key, F.explode(F.array_distinct("triggered")).alias("indicator"))
    two = signatures.select("id", F.explode(F.array_distinct("indicators")).alias("indicator"))
    return one.join(bounded_broadcast(two), "indicator").select(key, "id").distinct()


def outliers(df: DataFrame, keys: list[str], value: str, limit: float = 2.5) -> DataFrame:
    """Adds z (0 for deviation 0) and is_outlier per group."""
    w = Window.partitionBy(*keys)
    z = ratio(F.abs(F.col(value) - F.avg(value).over(w)), F.stddev_pop(value).over(w))
    return df.withColumn("z", F.when(F.col(value).isNotNull(), z)).withColumn("is_outlier", F.coalesce(F.col("z") > limit, F.lit(False)))


def with_gap(df: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Adds gap: microseconds since the row before."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("us", us).withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy(*keys).orderBy("us", *order)))


def regularity(df: DataFrame, keys: list[str], order: list[str], ts: str, limit: float = 0.08) -> DataFrame:
    """Variation of the gaps in ascending order per group; regular below the limit, from three rows on."""
    g = with_gap(df, keys, order, ts).groupBy(*keys).agg(
        F.count("*").alias("events"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap")
    )
    cv = F.when(F.col("mean_gap") == 0, 0.0).otherwise(F.col("std_gap") / F.col("mean_gap"))
    return g.withColumn("cv", cv).withColumn("regular", (F.col("events") >= 3) & F.coalesce(F.col("cv") < limit, F.lit(False)))


def gap_anomalies(df: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Share of gaps farther from their mean than twice the mean."""
    g = with_gap(df, keys, order, ts).where("gap IS NOT NULL")
    mean = F.avg("gap").over(Window.partitionBy(*keys))
    return g.withColumn("far", (F.abs(F.col("gap") - mean) > 2 * mean).cast("double")).groupBy(*keys).agg(F.avg("far").alias("share"), F.count("*").alias("gaps"))


def rapid_actions(df: DataFrame, keys: list[str], order: list[str], ts: str, max_gap_us: int) -> DataFrame:
    """Per group: actions, gaps below the limit, actions per minute (0 without a span) and whether either is suspicious."""
    g = with_gap(df, keys, order, ts).groupBy(*keys).agg(
        F.count("*").alias("actions"), F.count_if(F.col("gap") < max_gap_us).alias("rapid"), (F.max("us") - F.min("us")).alias("span")
    )
    per_minute = ratio(F.col("actions") * F.lit(60_000_000.0), F.col("span"))
    return g.withColumn("per_minute", per_minute).withColumn("suspicious", (F.col("rapid") > 5) | (F.col("per_minute") > 60))


def pattern_verdict(df: DataFrame, keys: list[str], order: list[str], ts: str, latency: str, payload: str) -> DataFrame:
    """insufficient_data below three events, else normal, suspicious or anomalous by the number of anomaly kinds."""
    df = df.withColumns({latency: F.coalesce(latency, F.lit(0.0)), payload: F.coalesce(payload, F.lit(256.0))})
    flags = outliers(outliers(df, keys, latency).withColumnRenamed("is_outlier", "lat_out"), keys, payload).groupBy(*keys).agg(
        F.max("lat_out").alias("latency_spike"), F.max("is_outlier").alias("payload_anomaly")
    )
    both = flags.join(regularity(df, keys, order, ts), keys)
    n = F.col("latency_spike").cast("int") + F.col("payload_anomaly").cast("int") + F.col("regular").cast("int")
    verdict = F.when(F.col("events") < 3, "insufficient_data").when(n == 0, "normal").when(n == 1, "suspicious").otherwise("anomalous")
    return both.select(*keys, "events", "latency_spike", "payload_anomaly", F.col("regular").alias("beaconing"), verdict.alias("verdict"))


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """Mean of the last n values against the n before, with a band of 20 %."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    ranked = df.withColumn("r", rank).where(F.col("r") <= 2 * n)
    g = ranked.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("r") <= n, F.col(value))), F.lit(0.0)).alias("recent"),
        F.coalesce(F.avg(F.when(F.col("r") > n, F.col(value))), F.lit(0.0)).alias("older"),
    )
    t = F.when(F.col("recent") > F.col("older") * 1.2, "increasing").when(F.col("recent") < F.col("older") * 0.8, "decreasing").otherwise("stable")
    return g.withColumn("trend", t)


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def rolling_count(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Adds hits: rows of the group within the last ``seconds``, both ends included."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("hits", F.count("*").over(w))


def binned(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The equal bin between two extremes that a value is in, the last one closed; a range of 0 counts as 1."""
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.least(F.lit(bins - 1), F.floor((value - low) / width * bins).cast("int"))


def _at_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the values at the ranks of the median and of both nearest quartiles."""
    w = Window.partitionBy(*keys)
    placed = rows.select(*keys, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    mid = F.floor(F.col("n") / 2)
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("v")))
    picked = placed.groupBy(*keys).agg(
        at(mid).alias("upper"), at(mid - 1).alias("lower"), at(F.floor(F.col("n") * 25 / 100)).alias("p25"), at(F.floor(F.col("n") * 75 / 100)).alias("p75"), F.max("n").alias("n")
    )
    median = F.when(F.col("n") % 2 == 1, F.col("upper")).otherwise((F.col("lower") + F.col("upper")) / 2)
    return picked.select(*keys, median.alias("median"), "p25", "p75")


def rhythm(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Statistics per key of a series of doubles, one row per value: typing or other timings in order. Null values and keys are left out.

    Moments, bins and steps are sums taken per task before rows move; ranks and the value before are windows. No
    series is gathered into an array.
    """
    present = rows.where(F.col(value).isNotNull())
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    v = F.col("v")
    s = present.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"))
    base = s.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt")
    )
    ranks = _at_ranks(s, keys, "v")
    fits = base.join(ranks, keys)
    beside = s.withColumn("before", F.lag("v").over(Window.partitionBy(*keys).orderBy(*[f"__o{i}" for i in range(len(order))]))).join(fits, keys)
    head, here, m = F.col("before"), F.when(F.col("before").isNotNull(), v), F.col("mean")
    counts = lambda bins, at: F.count_if(binned(v, F.col("min"), F.col("max"), bins) == at).cast("double")
    sums = beside.groupBy(*keys).agg(
        F.coalesce(F.sum((head - m) * (here - m)), F.lit(0.0)).alias("products"),
        F.coalesce(F.sum((head - m) * (head - m)), F.lit(0.0)).alias("squares"),
        F.coalesce(F.avg(F.abs(here - head)), F.lit(0.0)).alias("mean_step"),
        F.count_if(v > m).alias("above"),
        F.array(*[counts(10, i) for i in range(10)]).alias("tenths"),
        F.array(*[counts(5, i) for i in range(5)]).alias("fifths"),
    )
    deviations = _at_ranks(beside.select(*keys, F.abs(v - F.col("median")).alias("d")), keys, "d").select(*keys, F.col("median").alias("mad"))
    spread_out = F.col("std") > 0
    return fits.join(sums, keys).join(deviations, keys).select(
        *keys,
        F.col("n").cast("int").alias("n"),
        "mean",
        "std",
        "min",
        "max",
        "median",
        "p25",
        "p75",
        F.when(spread_out, F.col("skew")).otherwise(0.0).alias("skewness"),
        F.when(spread_out, F.col("kurt")).otherwise(0.0).alias("kurtosis"),
        (F.col("p75") - F.col("p25")).alias("iqr"),
        "mad",
        (F.col("above") / F.col("n")).alias("above_mean"),
        ratio(F.col("std"), F.col("mean")).alias("cv"),
        ratio(F.col("products"), F.col("squares")).alias("autocorrelation"),
        "mean_step",
        entropy_of(F.col("tenths")).alias("entropy"),
        F.transform("fifths", lambda c: c / F.col("n")).alias("bins"),
    )


def chain_hash(seq: Column, ts: Column, category: Column, message: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), ts.cast("string"), category, message, previous), 256)


def build_chain(entries: DataFrame, key: str) -> DataFrame:
    """Hash chain of each key's entries in order of seq. Every hash needs the one before, so this is a fold."""
    import hashlib

    def link(previous, row):
        previous = previous or "0" * 64
        h = hashlib.sha256("|".join(str(x) for x in (row["seq"], row["ts"], row["category"], row["message"], previous) if x is not None).encode()).hexdigest()
        return h, [(row[key], row["seq"], row["ts"], row["category"], row["message"], h, previous)]

    kind = entries.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, seq bigint, ts string, category string, message string, hash string, prev_hash string"
    return folded(entries.select(key, "seq", "ts", "category", "message"), [key], ["seq"], link, schema)


def verify_chain(chain: DataFrame, key: str) -> DataFrame:
    """Adds linked (prev_hash equals the hash before) and intact (own hash recomputes)."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy("seq")), F.lit("0" * 64))
    own = chain_hash(F.col("seq"), F.col("ts"), F.col("category"), F.col("message"), F.col("prev_hash"))
    return chain.withColumns({"linked": F.col("prev_hash") == before, "intact": F.col("hash") == own})

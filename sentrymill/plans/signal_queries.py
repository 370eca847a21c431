"""Queries over messages, link readings, scored flows and per-key state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators import scoring, signals, state
from sentrymill.sources.tables import spread, table


def message_threat_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"), "text")
    sent = table(spark, d, "messages").select(F.concat(F.lit("m"), F.col("delivery_id")).alias("key"), "text")
    s = scoring.message_scores(spread(docs.unionByName(sent)))
    return s.select("key", F.round("entropy", 6).alias("entropy"), "has_b64", "has_ip", "has_exec", "has_url", "score", "fired", "confidence", "attack_class", "level")


def feed_votes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed")
    p = scoring.soft_vote(F.map_values("model_scores"), 8)
    return f.withColumn("vote", p).select(
        "feed_id", "vote", scoring.classified(F.col("malicious_probability")).alias("class"), scoring.level(F.col("malicious_probability")).alias("level"),
        scoring.advice(F.col("malicious_probability")).alias("advice"), scoring.client_level(F.col("malicious_probability")).alias("client_level"),
        scoring.server_advice(F.col("malicious_probability")).alias("server_level"),
        F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").otherwise("OTHER").alias("protocol_name"),
        F.regexp_replace(F.lower(F.coalesce("classification", F.lit("Normal"))), " ", "_").alias("category"),
        (F.coalesce("total_packets", F.lit(0)) > 1000).alias("packet_anomaly"), F.coalesce(F.col("dst_port").isin(22, 23, 445, 3389, 4444), F.lit(False)).alias("watched_port"),
    )


WEIGHTS = {"lgbm_deep": 0.97, "lgbm_wide": 0.96, "lgbm_fast": 0.95, "xgb_deep": 0.97, "xgb_balanced": 0.96, "cat_deep": 0.96}


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("model_scores IS NOT NULL")
    score = scoring.weighted_vote({n: F.coalesce(F.col("model_scores")[n], F.lit(0.0)) for n in WEIGHTS}, WEIGHTS)
    return f.select("feed_id", F.round(score, 6).alias("score"), (F.round(score, 6) > 0.5).alias("malicious"))


def traffic_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "combined_dataset")
    v = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    watched = F.coalesce(F.col("dst_port").isin(22, 23, 445, 3389, 4444, 6666), F.lit(False))
    variation = F.when(v("fwd_pkt_len_max") == 0, 0.0).otherwise(v("fwd_pkt_len_std") / F.when(v("fwd_pkt_len_max") == 0, 1.0).otherwise(v("fwd_pkt_len_max")))
    score = scoring.traffic_score(v("fwd_packets") + v("bwd_packets"), v("fwd_bytes") + v("bwd_bytes"), v("duration") / 1000, variation, F.lit(0.0), watched)
    return c.select("record_id", score.alias("score")).withColumn("class", F.when(F.col("score") < 0.2, "Normal").when(F.col("score") < 0.5, "Suspicious").otherwise("Malicious"))


def multi_signal_score(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("src_ip IS NOT NULL")
    g = signals.with_gap(f, ["src_ip"], ["feed_id"], "ts").groupBy("src_ip").agg(
        F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span"), F.count_if(F.col("gap") < 60_000_000).alias("rapid"),
        F.count_distinct("dst_port").alias("kinds"), F.count_distinct("dst_ip").alias("dests"), F.coalesce(F.sum("total_bytes"), F.lit(0.0)).alias("bytes"), F.count("gap").alias("gaps"),
    )
    score = scoring.multi_signal_score(F.col("n"), F.col("span"), F.col("rapid"), F.col("kinds"), F.col("dests"), F.col("bytes"), F.col("n"), F.lit(0.0))
    conf = scoring.signal_confidence(F.col("n"), F.col("n"), F.col("bytes"), F.col("gaps"))
    return g.select("src_ip", "n", "rapid", "kinds", "dests", F.round(score, 6).alias("score"), F.round(conf, 6).alias("confidence"))


def signal_health(spark: SparkSession, d: str) -> DataFrame:
    return signals.health(table(spark, d, "signals")).select("reading_id", F.array_join("issues", ",").alias("issues"), "health_score", "status")


def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    s = signals.health_summary(signals.health(table(spark, d, "signals")))
    return s.withColumn("avg_score", F.round("avg_score", 6))


def ew_threat_score(spark: SparkSession, d: str) -> DataFrame:
    e = signals.indicators(table(spark, d, "signals"))
    return e.select("reading_id", F.array_join("triggered", ",").alias("triggered"), "threat_score", "threat_class", F.array_join("signatures", ",").alias("signatures"), "severity")


def signature_match(spark: SparkSession, d: str) -> DataFrame:
    return signals.signature_matches(signals.indicators(table(spark, d, "signals")), "reading_id", signals.signature_table(spark))


def pattern_verdict(spark: SparkSession, d: str) -> DataFrame:
    return signals.pattern_verdict(table(spark, d, "signals"), ["source_id"], ["reading_id"], "ts", "latency_ms", "payload_size_bytes")


def zscore_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = signals.outliers(table(spark, d, "signals"), ["source_id"], "latency_ms")
    return o.select("reading_id", F.round("z", 6).alias("z"), "is_outlier")


def iat_beaconing(spark: SparkSession, d: str) -> DataFrame:
    r = signals.regularity(table(spark, d, "signals"), ["source_id"], ["reading_id"], "ts")
    return r.select("source_id", "events", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 6).alias("cv"), "regular")


def iat_anomaly_share(spark: SparkSession, d: str) -> DataFrame:
    g = signals.gap_anomalies(table(spark, d, "feed").where("src_ip IS NOT NULL"), ["src_ip"], ["feed_id"], "ts")
    return g.select("src_ip", F.round("share", 6).alias("share"), "gaps")


def rapid_actions(spark: SparkSession, d: str) -> DataFrame:
    r = signals.rapid_actions(table(spark, d, "events"), ["user_id"], ["event_id"], "ts", 600_000_000)
    return r.select("user_id", "actions", "rapid", "span", F.round("per_minute", 8).alias("per_minute"), "suspicious")


def threat_trend(spark: SparkSession, d: str) -> DataFrame:
    t = signals.trend(table(spark, d, "feed").where("src_ip IS NOT NULL"), ["src_ip"], ["ts", "feed_id"], "malicious_probability")
    return t.select("src_ip", F.round("recent", 6).alias("recent"), F.round("older", 6).alias("older"), "trend")


def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    return signals.last_n(table(spark, d, "feed"), ["src_ip"], ["ts", "feed_id"], 50).select("src_ip", "feed_id", "rank")


def rolling_detections_60s(spark: SparkSession, d: str) -> DataFrame:
    return signals.rolling_count(table(spark, d, "feed"), ["src_ip"], "ts", 60).select("feed_id", "hits")


def feed_counters(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed")
    bpp = F.round(F.avg(F.when(F.col("total_packets") > 0, F.col("total_bytes") / F.col("total_packets"))))
    return f.agg(
        F.count("*").alias("flows"), F.count_if(F.col("malicious_probability") >= 0.40).alias("threats"), bpp.alias("bytes_per_packet"),
        ((F.count("*") >= 10) & (F.avg((F.coalesce("malicious_probability", F.lit(0.0)) > 0.65).cast("double")) > 0.3)).alias("high_threat"),
        F.round(F.avg("malicious_probability"), 6).alias("avg_score"), F.max("malicious_probability").alias("max_score"),
    )


def _rhythm(spark: SparkSession, d: str) -> DataFrame:
    g = signals.with_gap(table(spark, d, "events"), ["user_id"], ["event_id"], "ts").where("gap > 0")
    return signals.rhythm(g.withColumn("minutes", F.round(F.col("gap") / 60_000_000, 3)), ["user_id"], ["us", "event_id"], "minutes")


def keystroke_stats(spark: SparkSession, d: str) -> DataFrame:
    r = _rhythm(spark, d)
    return r.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in r.dtypes if c not in ("bins", "autocorrelation", "entropy", "mean_step")])


def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    r = _rhythm(spark, d)
    return r.select("user_id", F.posexplode("bins").alias("bin", "share")).select("user_id", "bin", F.round("share", 6).alias("share"))


def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    r = _rhythm(spark, d)
    return r.select("user_id", F.round("autocorrelation", 6).alias("autocorrelation"), F.round("entropy", 6).alias("entropy"), F.round("mean_step", 4).alias("mean_step"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "messages").where("chat_id IS NOT NULL")
    return b.select("chat_id", F.col("delivery_id").alias("seq"), F.unix_micros(F.col("received_at").cast("timestamp")).cast("string").alias("ts"), F.col("status").alias("category"), F.coalesce("text", F.lit("")).alias("message"))


def audit_chain_build(spark: SparkSession, d: str) -> DataFrame:
    return signals.build_chain(_entries(spark, d), "chat_id")


def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    v = signals.verify_chain(signals.build_chain(_entries(spark, d), "chat_id"), "chat_id")
    return v.groupBy("chat_id").agg(F.count("*").alias("entries"), F.min("linked").alias("linked"), F.min("intact").alias("intact"))


def response_tiers(spark: SparkSession, d: str) -> DataFrame:
    return state.response_tiers(table(spark, d, "feed"), "src_ip", "ts", "malicious_probability", "feed_id", 6 * 3_600_000_000, 86_400_000_000)


def response_controls(spark: SparkSession, d: str) -> DataFrame:
    """Response tiers with some sources unblocked by hand, and the engine switched off at times."""
    b = table(spark, d, "blocks").where("ts IS NOT NULL").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    unblocks = b.where("block_id % 3 = 0").select(F.col("ip").alias("k"), (F.col("us") + 3 * 3_600_000_000).alias("us"))
    toggles = b.where("block_id % 10 = 0").groupBy("us").agg(F.bool_or(F.col("block_id") % 20 == 0).alias("on"))
    return state.response_tiers(table(spark, d, "feed"), "src_ip", "ts", "malicious_probability", "feed_id", 6 * 3_600_000_000, 86_400_000_000, unblocks, toggles)


def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    return state.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", 5, 24 * 3_600_000_000)


def batch_flush(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "feed").where("dst_port IS NOT NULL AND protocol IS NOT NULL")
    return state.batched(feed, "protocol", "dst_port", "ts", "feed_id", 5, 86_400_000_000)


def cas_replay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    return state.cas_replay(e.withColumn("expected", F.when(F.col("k") % 4 == 0, F.lit(None)).otherwise(F.col("k") % 3)), "user_id", "event_id", "expected", "event_type")


def prekey_stock(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("view", "signup"), "add").otherwise("take").alias("kind"))
    return state.consumed_keys(e, "user_id", "event_id", "kind", "event_id")


def block_expiry(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks")
    return state.expired_blocks(b, "ts", "auto_unblock_at", F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")).select("block_id", "ip", "tier", "active")


def policy_bands(spark: SparkSession, d: str) -> DataFrame:
    p = state.adjusted_policy(F.col("malicious_probability"))
    return table(spark, d, "feed").where("malicious_probability IS NOT NULL").select("feed_id", *[c.alias(n) for n, c in p.items()])


def padding_rates(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("src_ip IS NOT NULL AND ts IS NOT NULL")
    r = state.padding_rates(f, "src_ip", ["ts", "feed_id"], "malicious_probability")
    return r.select("src_ip", "feed_id", F.round("rate", 6).alias("rate"))


def flat_tree_predict(spark: SparkSession, d: str) -> DataFrame:
    one = scoring.FlatTree((0, -1, 1, -1, -1), (64.0, 0, 1000.0, 0, 0), (1, 0, 3, 0, 0), (2, 0, 4, 0, 0), (0, 0.1, 0, 0.6, 0.9))
    two = scoring.FlatTree((2, -1, -1), (443.0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 0.2, 0.7))
    v = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("total_packets", "total_bytes", "dst_port")]
    return table(spark, d, "feed").select("feed_id", F.round(scoring.forest_score([one, two], [0.6, 0.4], v), 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        message_threat_scan, feed_votes, weighted_vote, traffic_scores, multi_signal_score, signal_health, signal_summary, ew_threat_score, signature_match,
        pattern_verdict, zscore_outliers, iat_beaconing, iat_anomaly_share, rapid_actions, threat_trend, last_n_history, rolling_detections_60s, feed_counters,
        keystroke_stats, histogram_bins, autocorrelation, audit_chain_build, audit_chain_verify, response_tiers, response_controls, rate_limiter, batch_flush, cas_replay,
        prekey_stock, block_expiry, policy_bands, padding_rates, flat_tree_predict,
    )
}

_SCAN = r"""
texts AS (SELECT 'd' || doc_id AS key, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'm' || delivery_id, coalesce(text, '') FROM messages),
flags AS (
  SELECT key, t, coalesce(list_entropy(string_split(t, '')), 0) AS entropy, regexp_matches(t, '[A-Za-z0-9+/]{40,}={0,2}') AS b64,
         regexp_matches(t, '(^|[^\p{L}\p{N}_])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}($|[^\p{L}\p{N}_])') AS ip, regexp_matches(t, '(?i)exec|eval|shell|cmd|powershell|bash|/bin/') AS ex,
         regexp_matches(t, 'https?://[^\s]{20,}') AS url FROM texts),
scored AS (
  SELECT *, round(least(1.0, (entropy > 4.5)::INT * 0.10::DOUBLE + b64::INT * 0.20::DOUBLE + ip::INT * 0.08::DOUBLE + ex::INT * 0.45::DOUBLE + (url AND length(t) > 200)::INT * 0.15::DOUBLE + (length(t) > 4096)::INT * 0.05::DOUBLE), 4) AS score,
         (entropy > 4.5)::INT + b64::INT + ip::INT + ex::INT + url::INT + (length(t) > 4096)::INT AS fired FROM flags)
"""
_GAPS = """
g AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {k} ORDER BY ts, {o}) AS gap FROM {t} {w})
"""
_RULES = (
    ("coalesce(snr_db, 30) < 5", 0.35, ("snr_drop",)),
    ("coalesce(snr_db, 30) >= 5 AND coalesce(snr_db, 30) < 10", 0.15, ("snr_weak",)),
    ("coalesce(timing_drift_ms, 0) > 500", 0.25, ("timing_drift",)),
    ("coalesce(replay_flag, false)", 0.30, ("replay_detected",)),
    ("coalesce(packet_loss_pct, 0) > 10 AND coalesce(latency_ms, 20) > 300", 0.25, ("packet_flood",)),
    ("coalesce(iat_variance, 0) < 0.05 AND coalesce(payload_size_bytes, 256) < 64", 0.20, ("regular_iat", "small_payload")),
    ("coalesce(unique_src_count, 1) > 5", 0.15, ("unknown_src",)),
)
_EW = f"""
ew AS (
  SELECT *, round(least(1.0, {" + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w, _ in _RULES)}), 4) AS s,
         list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, names in _RULES for n in names)}], lambda x: x IS NOT NULL) AS trig
  FROM signals),
sig AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s[0]}', {list(s[2])}, '{s[3]}')" for i, s in enumerate(signals.SIGNATURES))}) AS v(o, id, ind, sev)),
hit AS (SELECT e.reading_id, list(s.id ORDER BY s.o) AS ids, arg_min(s.sev, s.o) AS sev FROM ew e JOIN sig s ON list_has_any(e.trig, s.ind) GROUP BY 1)
"""
_TIMES = f"""
{_GAPS.format(k="user_id", o="event_id", t="events", w="")},
v AS (SELECT user_id, us, event_id, round(gap / 60000000, 3) AS x FROM g WHERE gap > 0),
m AS (SELECT user_id, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi, median(x) AS med, list(x ORDER BY x) AS srt FROM v GROUP BY 1),
j AS (SELECT v.*, m.n, m.mean, m.std, m.lo, m.hi, m.med, m.srt, lead(x) OVER (PARTITION BY v.user_id ORDER BY us, event_id) AS nx,
             CASE WHEN m.hi = m.lo THEN 1.0 ELSE m.hi - m.lo END AS rng FROM v JOIN m USING (user_id))
"""
_TIER = """
rows_ AS (
  SELECT src_ip, epoch_us(ts) AS us, malicious_probability AS score, row_number() OVER (PARTITION BY src_ip ORDER BY ts, feed_id) AS rn FROM feed
  WHERE src_ip IS NOT NULL AND src_ip NOT IN ('127.0.0.1', '::1', '?', '') AND malicious_probability IS NOT NULL AND ts IS NOT NULL),
"""

SQL = {
    "message_threat_scan": f"""WITH {_SCAN} SELECT key, round(entropy, 6) AS entropy, b64 AS has_b64, ip AS has_ip, ex AS has_exec, url AS has_url, score, fired,
round(0.90 + least(fired * 0.015, 0.09), 4)::DOUBLE AS confidence,
CASE WHEN score < 0.10 THEN 'Benign' WHEN ex THEN 'Command Injection' WHEN b64 THEN 'Data Exfiltration' WHEN url THEN 'Phishing / C2' ELSE 'Anomalous Activity' END AS attack_class,
CASE WHEN score < 0.35 THEN 'safe' WHEN score < 0.55 THEN 'low' WHEN score < 0.75 THEN 'medium' ELSE 'critical' END AS level FROM scored""",
    "feed_votes": """SELECT feed_id, round(coalesce(list_avg(list_filter(map_values(model_scores), lambda x: x IS NOT NULL)), 0), 8) AS vote,
CASE WHEN p < 0.35 THEN 'Normal' WHEN p < 0.55 THEN 'Suspicious' WHEN p < 0.75 THEN 'Malicious' WHEN p IS NOT NULL THEN 'Critical' END AS class,
CASE WHEN p < 0.35 THEN 'safe' WHEN p < 0.55 THEN 'low' WHEN p < 0.75 THEN 'medium' WHEN p IS NOT NULL THEN 'critical' END AS level,
CASE WHEN p < 0.35 THEN 'Normal traffic. No action required.' WHEN p < 0.55 THEN 'Elevated risk. Increase monitoring frequency.' WHEN p < 0.75 THEN 'THREAT DETECTED. Review flow and apply firewall rules.'
     WHEN p IS NOT NULL THEN 'CRITICAL THREAT. Block source immediately and escalate.' END AS advice,
CASE WHEN p < 0.20 THEN 'safe' WHEN p < 0.40 THEN 'low' WHEN p < 0.65 THEN 'medium' WHEN p IS NOT NULL THEN 'critical' END AS client_level,
CASE WHEN p < 0.25 THEN 'normal' WHEN p < 0.50 THEN 'elevated' WHEN p < 0.75 THEN 'threat' WHEN p IS NOT NULL THEN 'critical' END AS server_level,
CASE WHEN protocol = 6 THEN 'TCP' WHEN protocol = 17 THEN 'UDP' ELSE 'OTHER' END AS protocol_name,
replace(lower(coalesce(classification, 'Normal')), ' ', '_') AS category, coalesce(total_packets, 0) > 1000 AS packet_anomaly, coalesce(dst_port IN (22, 23, 445, 3389, 4444), false) AS watched_port
FROM (SELECT *, malicious_probability AS p FROM feed)""",
    "weighted_vote": f"""SELECT feed_id, score, score > 0.5 AS malicious FROM (
SELECT feed_id, round({" + ".join(f"coalesce(model_scores['{n}'], 0) * {w / sum(WEIGHTS.values())!r}" for n, w in WEIGHTS.items())}, 6) AS score FROM feed WHERE model_scores IS NOT NULL)""",
    "traffic_scores": """SELECT record_id, score, CASE WHEN score < 0.2 THEN 'Normal' WHEN score < 0.5 THEN 'Suspicious' ELSE 'Malicious' END AS class FROM (
SELECT record_id, round(least(1.0, least(1.0, CASE WHEN mx = 0 THEN 0 ELSE sd / mx END) * 0.25::DOUBLE + coalesce(dst_port IN (22, 23, 445, 3389, 4444, 6666), false)::INT * 0.35::DOUBLE
  + (pk / secs > 500)::INT * 0.10::DOUBLE + (vol / secs > 1e6)::INT * 0.15::DOUBLE), 4) AS score
FROM (SELECT record_id, dst_port, coalesce(fwd_pkt_len_max, 0)::DOUBLE AS mx, coalesce(fwd_pkt_len_std, 0) AS sd, coalesce(fwd_packets, 0)::DOUBLE + coalesce(bwd_packets, 0) AS pk,
  coalesce(fwd_bytes, 0)::DOUBLE + coalesce(bwd_bytes, 0) AS vol, greatest(coalesce(duration, 0)::DOUBLE / 1000 / 1000, 0.001) AS secs FROM combined_dataset))""",
    "multi_signal_score": f"""WITH {_GAPS.format(k="src_ip", o="feed_id", t="feed", w="WHERE src_ip IS NOT NULL")},
a AS (SELECT src_ip, count(*) AS n, max(us) - min(us) AS span, count(*) FILTER (gap < 60000000) AS rapid, count(DISTINCT dst_port) AS kinds, count(DISTINCT dst_ip) AS dests,
             coalesce(sum(total_bytes), 0) AS bytes, count(gap) AS gaps FROM g GROUP BY 1)
SELECT src_ip, n, rapid, kinds, dests,
  round(0.15::DOUBLE + 0.25 * least(1.0, (n >= 2 AND span > 0 AND n * 60000000.0 / span > 60)::INT * 0.3 + (rapid > 5)::INT * 0.3 + (kinds > 20)::INT * 0.2)
   + 0.3 * least(1.0, (dests > 50)::INT * 0.3 + (bytes > 100000000)::INT * 0.3 + (n > 100)::INT * 0.2 + (dests > 0 AND n > 0 AND n::DOUBLE / dests > 10)::INT * 0.2), 6) AS score,
  round(greatest(0.1, least(1.0, 1.0::DOUBLE - (n < 10)::INT * 0.3 - (n = 0)::INT * 0.2 - (bytes = 0)::INT * 0.2 - (gaps = 0)::INT * 0.1)), 6) AS confidence FROM a""",
    "signal_health": """SELECT reading_id, concat_ws(',', CASE WHEN snr_db < 10 THEN 'snr' END, CASE WHEN latency_ms > 250 THEN 'latency' END, CASE WHEN jitter_ms > 30 THEN 'jitter' END, CASE WHEN packet_loss_pct > 2 THEN 'loss' END) AS issues,
1 - k / 4 AS health_score, CASE k WHEN 0 THEN 'nominal' WHEN 1 THEN 'degraded' WHEN 2 THEN 'impaired' ELSE 'critical' END AS status
FROM (SELECT *, (coalesce(snr_db < 10, false)::INT + coalesce(latency_ms > 250, false)::INT + coalesce(jitter_ms > 30, false)::INT + coalesce(packet_loss_pct > 2, false)::INT)::DOUBLE AS k FROM signals)""",
    "signal_summary": """SELECT round(avg(1 - k / 4), 6) AS avg_score, count(*) AS total, count(*) FILTER (k = 0) AS nominal, count(*) FILTER (k = 1) AS degraded, count(*) FILTER (k = 2) AS impaired, count(*) FILTER (k >= 3) AS critical
FROM (SELECT (coalesce(snr_db < 10, false)::INT + coalesce(latency_ms > 250, false)::INT + coalesce(jitter_ms > 30, false)::INT + coalesce(packet_loss_pct > 2, false)::INT)::DOUBLE AS k FROM signals)""",
    "ew_threat_score": f"""WITH {_EW} SELECT reading_id, array_to_string(trig, ',') AS triggered, s AS threat_score,
CASE WHEN s < 0.15 THEN 'clean' WHEN s < 0.35 THEN 'suspicious' WHEN s < 0.60 THEN 'threat' ELSE 'attack' END AS threat_class, coalesce(array_to_string(ids, ','), '') AS signatures,
coalesce(sev, CASE WHEN s > 0.5 THEN 'high' WHEN s > 0.25 THEN 'medium' ELSE 'low' END) AS severity FROM ew LEFT JOIN hit USING (reading_id)""",
    "signature_match": f"WITH {_EW} SELECT reading_id, unnest(ids) AS id FROM hit",
    "pattern_verdict": f"""WITH {_GAPS.format(k="source_id", o="reading_id", t="signals", w="")},
z AS (SELECT *, coalesce(abs(coalesce(latency_ms, 0) - avg(coalesce(latency_ms, 0)) OVER w) / nullif(stddev_pop(coalesce(latency_ms, 0)) OVER w, 0), 0) > 2.5 AS lo,
             coalesce(abs(coalesce(payload_size_bytes, 256) - avg(coalesce(payload_size_bytes, 256)) OVER w) / nullif(stddev_pop(coalesce(payload_size_bytes, 256)) OVER w, 0), 0) > 2.5 AS po FROM g WINDOW w AS (PARTITION BY source_id)),
r AS (SELECT source_id, count(*) AS events, bool_or(lo) AS l, bool_or(po) AS p, count(*) >= 3 AND coalesce(CASE WHEN avg(gap) = 0 THEN 0 ELSE stddev_pop(gap) / avg(gap) END < 0.08, false) AS b FROM z GROUP BY 1)
SELECT source_id, events, l AS latency_spike, p AS payload_anomaly, b AS beaconing,
CASE WHEN events < 3 THEN 'insufficient_data' WHEN l::INT + p::INT + b::INT = 0 THEN 'normal' WHEN l::INT + p::INT + b::INT = 1 THEN 'suspicious' ELSE 'anomalous' END AS verdict FROM r""",
    "zscore_outliers": """SELECT reading_id, round(z, 6) AS z, coalesce(z > 2.5, false) AS is_outlier FROM (
SELECT reading_id, CASE WHEN latency_ms IS NOT NULL THEN coalesce(abs(latency_ms - avg(latency_ms) OVER w) / nullif(stddev_pop(latency_ms) OVER w, 0), 0) END AS z FROM signals WINDOW w AS (PARTITION BY source_id))""",
    "iat_beaconing": f"""WITH {_GAPS.format(k="source_id", o="reading_id", t="signals", w="")},
r AS (SELECT source_id, count(*) AS events, avg(gap) AS m, CASE WHEN avg(gap) = 0 THEN 0 ELSE stddev_pop(gap) / avg(gap) END AS cv FROM g GROUP BY 1)
SELECT source_id, events, round(m, 3) AS mean_gap, round(cv, 6) AS cv, events >= 3 AND coalesce(cv < 0.08, false) AS regular FROM r""",
    "iat_anomaly_share": f"""WITH {_GAPS.format(k="src_ip", o="feed_id", t="feed", w="WHERE src_ip IS NOT NULL")},
f AS (SELECT src_ip, (abs(gap - avg(gap) OVER w) > 2 * avg(gap) OVER w)::INT AS far FROM g WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY src_ip))
SELECT src_ip, round(avg(far), 6) AS share, count(*) AS gaps FROM f GROUP BY 1""",
    "rapid_actions": f"""WITH {_GAPS.format(k="user_id", o="event_id", t="events", w="")},
a AS (SELECT user_id, count(*) AS actions, count(*) FILTER (gap < 600000000) AS rapid, max(us) - min(us) AS span FROM g GROUP BY 1)
SELECT user_id, actions, rapid, span, round(coalesce(actions * 60000000.0::DOUBLE / nullif(span, 0), 0), 8) AS per_minute, rapid > 5 OR coalesce(actions * 60000000.0 / nullif(span, 0), 0) > 60 AS suspicious FROM a""",
    "threat_trend": """WITH r AS (SELECT src_ip, malicious_probability AS p, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC NULLS LAST, feed_id DESC) AS r FROM feed WHERE src_ip IS NOT NULL),
a AS (SELECT src_ip, coalesce(avg(p) FILTER (r <= 10), 0) AS recent, coalesce(avg(p) FILTER (r BETWEEN 11 AND 20), 0) AS older FROM r GROUP BY 1)
SELECT src_ip, round(recent, 6) AS recent, round(older, 6) AS older, CASE WHEN recent > older * 1.2 THEN 'increasing' WHEN recent < older * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM a""",
    "last_n_history": """SELECT src_ip, feed_id, rank FROM (SELECT src_ip, feed_id, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC NULLS LAST, feed_id DESC) AS rank FROM feed) WHERE rank <= 50""",
    "rolling_detections_60s": """SELECT feed_id, count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS hits FROM feed""",
    "feed_counters": """SELECT count(*) AS flows, count(*) FILTER (malicious_probability >= 0.40) AS threats, round(avg(total_bytes / total_packets) FILTER (total_packets > 0)) AS bytes_per_packet,
count(*) >= 10 AND avg((coalesce(malicious_probability, 0) > 0.65)::INT) > 0.3 AS high_threat, round(avg(malicious_probability), 6) AS avg_score, max(malicious_probability) AS max_score FROM feed""",
    "keystroke_stats": f"""WITH {_TIMES},
dev AS (SELECT user_id, median(abs(x - med)) AS mad, avg((x > mean)::INT) AS above, avg(((x - mean) / nullif(std, 0)) ** 3) AS sk, avg(((x - mean) / nullif(std, 0)) ** 4) - 3 AS ku FROM j GROUP BY 1)
SELECT user_id, n, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(med, 4) AS median, round(srt[n * 25 // 100 + 1], 4) AS p25, round(srt[n * 75 // 100 + 1], 4) AS p75,
  round(coalesce(sk, 0), 4) AS skewness, round(coalesce(ku, 0), 4) AS kurtosis, round(srt[n * 75 // 100 + 1] - srt[n * 25 // 100 + 1], 4) AS iqr, round(mad, 4) AS mad, round(above, 4) AS above_mean,
  round(CASE WHEN mean = 0 THEN 0 ELSE std / mean END, 4) AS cv FROM m JOIN dev USING (user_id)""",
    "histogram_bins": f"""WITH {_TIMES}, b AS (SELECT user_id, least(4, floor((x - lo) / rng * 5))::INT AS bin, n FROM j),
u AS (SELECT user_id, n, unnest(range(5))::INT AS bin FROM m)
SELECT u.user_id, u.bin, round(count(b.bin) / u.n, 6) AS share FROM u LEFT JOIN b ON b.user_id = u.user_id AND b.bin = u.bin GROUP BY u.user_id, u.bin, u.n""",
    "autocorrelation": f"""WITH {_TIMES},
a AS (SELECT user_id, coalesce(sum((x - mean) * (nx - mean)) FILTER (nx IS NOT NULL) / nullif(sum((x - mean) ** 2) FILTER (nx IS NOT NULL), 0), 0) AS ac, coalesce(avg(abs(nx - x)), 0) AS st FROM j GROUP BY 1),
c AS (SELECT user_id, least(9, floor((x - lo) / rng * 10)) AS bin, count(*) AS c, any_value(n) AS n FROM j GROUP BY 1, 2),
e AS (SELECT user_id, -sum(c / n * log2(c / n)) AS en FROM c GROUP BY 1)
SELECT user_id, round(ac, 6) AS autocorrelation, round(en, 6) AS entropy, round(st, 4) AS mean_step FROM a JOIN e USING (user_id)""",
    "audit_chain_verify": "SELECT chat_id, count(*) AS entries, true AS linked, true AS intact FROM messages WHERE chat_id IS NOT NULL GROUP BY 1",
    "audit_chain_build": """WITH RECURSIVE e AS (SELECT chat_id, delivery_id AS seq, epoch_us(received_at)::VARCHAR AS ts, status AS category, coalesce(text, '') AS message,
  row_number() OVER (PARTITION BY chat_id ORDER BY delivery_id) AS rn FROM messages WHERE chat_id IS NOT NULL),
r AS (SELECT chat_id, seq, ts, category, message, rn, repeat('0', 64) AS prev_hash, sha256(concat_ws('|', seq::VARCHAR, ts, category, message, repeat('0', 64))) AS hash FROM e WHERE rn = 1
UNION ALL SELECT n.chat_id, n.seq, n.ts, n.category, n.message, n.rn, r.hash, sha256(concat_ws('|', n.seq::VARCHAR, n.ts, n.category, n.message, r.hash)) FROM r JOIN e n ON n.chat_id = r.chat_id AND n.rn = r.rn + 1)
SELECT chat_id, seq, ts, category, message, hash, prev_hash FROM r""",
    "batch_flush": """WITH RECURSIVE f AS (SELECT protocol AS lane, dst_port::VARCHAR AS hop, epoch_us(ts) AS us, row_number() OVER (PARTITION BY protocol ORDER BY epoch_us(ts) NULLS LAST, feed_id) AS rn
  FROM feed WHERE dst_port IS NOT NULL AND protocol IS NOT NULL),
r AS (SELECT lane, 0::BIGINT AS rn, 0 AS n, (SELECT min(us) FROM f f2 WHERE f2.lane = f1.lane) AS last, MAP {}::MAP(VARCHAR, INT) AS held, []::STRUCT(flush INT, hop VARCHAR, packets INT)[] AS out FROM (SELECT DISTINCT lane FROM f) f1
UNION ALL SELECT lane, rn, n0 + full_::INT, CASE WHEN full_ OR timed THEN us ELSE last END, CASE WHEN full_ THEN MAP {}::MAP(VARCHAR, INT) ELSE held1 END,
  list_concat(CASE WHEN timed THEN list_transform(map_entries(held), lambda x: {'flush': n, 'hop': x.key, 'packets': x.value}) ELSE [] END,
              CASE WHEN full_ THEN list_transform(map_entries(held1), lambda x: {'flush': n0, 'hop': x.key, 'packets': x.value}) ELSE [] END)
FROM (SELECT *, held1[hop] >= 5 AS full_ FROM (SELECT *, map_concat(h0, MAP([hop], [coalesce(h0[hop], 0) + 1])) AS held1 FROM (SELECT *, CASE WHEN timed THEN MAP {}::MAP(VARCHAR, INT) ELSE held END AS h0, n + timed::INT AS n0
FROM (SELECT f.lane, f.rn, f.hop, f.us, r.n, r.last, r.held, cardinality(r.held) > 0 AND f.us - r.last >= 86400000000 AS timed FROM r JOIN f ON f.lane = r.lane AND f.rn = r.rn + 1))))),
flushed AS (SELECT lane, unnest(out) AS x FROM r UNION ALL
  SELECT lane, unnest(list_transform(map_entries(held), lambda x: {'flush': n, 'hop': x.key, 'packets': x.value})) FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lane ORDER BY rn DESC) = 1))
SELECT lane AS protocol, x.flush AS flush, x.hop AS dst_port, x.packets AS packets, greatest(0, 5 - x.packets)::INT AS padding FROM flushed""",
    "rate_limiter": """WITH RECURSIVE rows_ AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, us AS anchor, 1 AS c, true AS allowed FROM rows_ WHERE rn = 1
UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN n.us - r.anchor > 86400000000 THEN n.us ELSE r.anchor END,
  CASE WHEN n.us - r.anchor > 86400000000 THEN 1 WHEN r.c >= 5 THEN r.c ELSE r.c + 1 END, n.us - r.anchor > 86400000000 OR r.c < 5
FROM r JOIN rows_ n ON n.user_id = r.user_id AND n.rn = r.rn + 1) SELECT event_id, user_id, allowed FROM r""",
    "cas_replay": """WITH RECURSIVE rows_ AS (SELECT user_id, event_id, CASE WHEN json_extract(props, '$.k')::INT % 4 = 0 THEN NULL ELSE json_extract(props, '$.k')::INT % 3 END AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, coalesce(e, 0) = 0 AS applied, (coalesce(e, 0) = 0)::BIGINT AS version FROM rows_ WHERE rn = 1
UNION ALL SELECT n.user_id, n.event_id, n.rn, coalesce(n.e, r.version) = r.version, r.version + (coalesce(n.e, r.version) = r.version)::BIGINT FROM r JOIN rows_ n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT event_id, user_id, applied, version FROM r""",
    "response_tiers": f"""WITH RECURSIVE {_TIER}
r AS (
  SELECT src_ip, us, score, 0::BIGINT AS rn, []::BIGINT[] AS hist, NULL::INT AS tier, NULL::BIGINT AS until, NULL::INT AS lifted, NULL::BIGINT AS lifted_at, 0 AS hits, NULL::INT AS t0, true AS skip FROM rows_ WHERE rn = 1
  UNION ALL
  SELECT src_ip, us, score, rn, hist, CASE WHEN skip THEN t0 WHEN score >= 0.92 OR (score >= 0.65 AND hits >= 3) THEN 1 WHEN score >= 0.80 THEN coalesce(t0, 2) ELSE t0 END,
         CASE WHEN skip THEN u0 WHEN score >= 0.92 OR (score >= 0.65 AND hits >= 3) OR (score >= 0.80 AND t0 IS NULL) THEN us + 86400000000 ELSE u0 END, lifted, lifted_at, hits, t0, skip
  FROM (SELECT *, list_sum(list_transform(hist, lambda h: (us - h <= 21600000000)::INT))::INT AS hits FROM (
    SELECT n.src_ip, n.us, n.score, n.rn, CASE WHEN up THEN NULL ELSE r.tier END AS t0, CASE WHEN up THEN NULL ELSE r.until END AS u0, CASE WHEN up THEN r.tier END AS lifted, CASE WHEN up THEN r.until END AS lifted_at,
           coalesce(NOT up AND r.tier = 1, false) AS skip, CASE WHEN NOT up AND r.tier = 1 THEN r.hist ELSE list_append(r.hist, n.us)[-50:] END AS hist
    FROM r JOIN rows_ n ON n.src_ip = r.src_ip AND n.rn = r.rn + 1, LATERAL (SELECT coalesce(n.us >= r.until, false) AS up)))),
a AS (
  SELECT src_ip, lifted_at AS us, 'UNBLOCK' AS action, lifted AS tier, NULL::DOUBLE AS score, 0 AS hits, NULL::INT AS blocked_tier FROM r WHERE lifted IS NOT NULL
  UNION ALL SELECT src_ip, us, 'T1_BLOCK', 1, score, hits, 1 FROM r WHERE NOT skip AND score >= 0.92
  UNION ALL SELECT src_ip, us, 'T2_RESET', 2, score, hits, coalesce(t0, 2) FROM r WHERE NOT skip AND score >= 0.80 AND score < 0.92
  UNION ALL SELECT src_ip, us, 'T1_ESCALATED', 1, score, hits, 1 FROM r WHERE NOT skip AND score >= 0.80 AND score < 0.92 AND hits >= 3
  UNION ALL SELECT src_ip, us, 'T3_TRACK', 3, score, hits, t0 FROM r WHERE NOT skip AND score >= 0.65 AND score < 0.80
  UNION ALL SELECT src_ip, us, 'T1_RATE', 1, score, hits, 1 FROM r WHERE NOT skip AND score >= 0.65 AND score < 0.80 AND hits >= 3)
SELECT * FROM a""",
    "response_controls": """WITH RECURSIVE toggles AS (SELECT epoch_us(ts) AS us, bool_or(block_id % 20 = 0) AS is_on FROM blocks WHERE block_id % 10 = 0 AND ts IS NOT NULL GROUP BY 1),
scored AS (SELECT src_ip, epoch_us(ts) AS us, malicious_probability AS score, feed_id AS o FROM feed WHERE src_ip NOT IN ('127.0.0.1', '::1', '?', '') AND malicious_probability IS NOT NULL AND ts IS NOT NULL),
allowed AS (SELECT s.* FROM scored s WHERE coalesce((SELECT arg_max(t.is_on, t.us) FROM toggles t WHERE t.us <= s.us), true)),
both_ AS (SELECT *, false AS ctl FROM allowed UNION ALL SELECT ip, epoch_us(ts) + 10800000000, NULL, -1, true FROM blocks WHERE block_id % 3 = 0 AND ip IS NOT NULL AND ts IS NOT NULL),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, o) AS rn FROM both_),
r AS (
  SELECT src_ip, us, score, ctl, 0::BIGINT AS rn, []::BIGINT[] AS hist, NULL::INT AS tier, NULL::BIGINT AS until, NULL::INT AS lifted, NULL::BIGINT AS lifted_at, 0 AS hits, NULL::INT AS t0, true AS skip FROM rows_ WHERE rn = 1
  UNION ALL
  SELECT src_ip, us, score, ctl, rn, hist, CASE WHEN ctl THEN NULL WHEN skip THEN t0 WHEN score >= 0.92 OR (score >= 0.65 AND hits >= 3) THEN 1 WHEN score >= 0.80 THEN coalesce(t0, 2) ELSE t0 END,
         CASE WHEN ctl THEN NULL WHEN skip THEN u0 WHEN score >= 0.92 OR (score >= 0.65 AND hits >= 3) OR (score >= 0.80 AND t0 IS NULL) THEN us + 86400000000 ELSE u0 END, lifted, lifted_at, hits, t0, skip
  FROM (SELECT *, list_sum(list_transform(hist, lambda h: (us - h <= 21600000000)::INT))::INT AS hits FROM (
    SELECT n.src_ip, n.us, n.score, n.ctl, n.rn, CASE WHEN up THEN NULL ELSE r.tier END AS t0, CASE WHEN up THEN NULL ELSE r.until END AS u0, CASE WHEN up THEN r.tier END AS lifted, CASE WHEN up THEN r.until END AS lifted_at,
           n.ctl OR coalesce(NOT up AND r.tier = 1, false) AS skip, CASE WHEN n.ctl OR (NOT up AND r.tier = 1) THEN r.hist ELSE list_append(r.hist, n.us)[-50:] END AS hist
    FROM r JOIN rows_ n ON n.src_ip = r.src_ip AND n.rn = r.rn + 1, LATERAL (SELECT coalesce(n.us >= r.until, false) AS up)))),
a AS (
  SELECT src_ip, lifted_at AS us, 'UNBLOCK' AS action, lifted AS tier, NULL::DOUBLE AS score, 0 AS hits, NULL::INT AS blocked_tier FROM r WHERE lifted IS NOT NULL
  UNION ALL SELECT src_ip, us, 'UNBLOCKED', t0, 0.0, 0, NULL FROM r WHERE rn > 0 AND ctl AND t0 IS NOT NULL
  UNION ALL SELECT src_ip, us, 'T1_BLOCK', 1, score, hits, 1 FROM r WHERE NOT skip AND score >= 0.92
  UNION ALL SELECT src_ip, us, 'T2_RESET', 2, score, hits, coalesce(t0, 2) FROM r WHERE NOT skip AND score >= 0.80 AND score < 0.92
  UNION ALL SELECT src_ip, us, 'T1_ESCALATED', 1, score, hits, 1 FROM r WHERE NOT skip AND score >= 0.80 AND score < 0.92 AND hits >= 3
  UNION ALL SELECT src_ip, us, 'T3_TRACK', 3, score, hits, t0 FROM r WHERE NOT skip AND score >= 0.65 AND score < 0.80
  UNION ALL SELECT src_ip, us, 'T1_RATE', 1, score, hits, 1 FROM r WHERE NOT skip AND score >= 0.65 AND score < 0.80 AND hits >= 3)
SELECT * FROM a""",
    "prekey_stock": """WITH RECURSIVE rows_ AS (SELECT user_id, event_id, event_type IN ('view', 'signup') AS adds, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT user_id, 0::BIGINT AS event_id, true AS adds, 0::BIGINT AS rn, []::BIGINT[] AS stock, NULL::BIGINT AS taken FROM rows_ WHERE rn = 1
UNION ALL SELECT n.user_id, n.event_id, n.adds, n.rn, CASE WHEN n.adds THEN list_append(r.stock, n.event_id) ELSE r.stock[:-2] END, CASE WHEN NOT n.adds THEN r.stock[-1] END FROM r JOIN rows_ n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT event_id, user_id, taken::VARCHAR AS taken, len(stock)::INT AS left FROM r WHERE rn > 0 AND NOT adds""",
    "block_expiry": "SELECT block_id, ip, tier, ts <= TIMESTAMP '2025-03-01' AND (auto_unblock_at IS NULL OR auto_unblock_at > TIMESTAMP '2025-03-01') AS active FROM blocks",
    "policy_bands": """SELECT feed_id, CASE WHEN p > 0.8 THEN 60 WHEN p > 0.6 THEN 300 WHEN p > 0.4 THEN 3600 ELSE 7200 END AS rekey_s, (CASE WHEN p > 0.8 THEN 0.9 WHEN p > 0.6 THEN 0.6 WHEN p > 0.4 THEN 0.3 ELSE 0.1 END)::DOUBLE AS padding_rate,
CASE WHEN p > 0.8 THEN 5 WHEN p > 0.6 THEN 3 WHEN p > 0.4 THEN 2 ELSE 1 END AS path_length FROM (SELECT feed_id, malicious_probability AS p FROM feed WHERE malicious_probability IS NOT NULL)""",
    "padding_rates": """WITH RECURSIVE rows_ AS (SELECT src_ip, feed_id, malicious_probability AS s, row_number() OVER (PARTITION BY src_ip ORDER BY ts, feed_id) AS rn FROM feed WHERE src_ip IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT src_ip, 0::BIGINT AS feed_id, 0::BIGINT AS rn, 0.2::DOUBLE AS rate FROM rows_ WHERE rn = 1
UNION ALL SELECT n.src_ip, n.feed_id, n.rn, least(0.8::DOUBLE, CASE WHEN n.s > 0.7 THEN least(r.rate * 1.5, 0.9) WHEN n.s < 0.3 AND r.rate > 0.1 THEN r.rate * 0.8 ELSE r.rate END) FROM r JOIN rows_ n ON n.src_ip = r.src_ip AND n.rn = r.rn + 1)
SELECT src_ip, feed_id, round(rate, 6) AS rate FROM r WHERE rn > 0""",
    "flat_tree_predict": """SELECT feed_id, round(0.6::DOUBLE * CASE WHEN coalesce(total_packets, 0) <= 64 THEN 0.1 WHEN coalesce(total_bytes, 0) <= 1000 THEN 0.6 ELSE 0.9 END
+ 0.4::DOUBLE * CASE WHEN coalesce(dst_port, 0) <= 443 THEN 0.2 ELSE 0.7 END, 6) AS score FROM feed""",
}

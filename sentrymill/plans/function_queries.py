"""Queries over scalar functions, matrices, typing rhythm and the remaining projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.functions import scalars as sc
from sentrymill.operators import chat, learn, matrices, scoring, typing_rhythm
from sentrymill.plans.views import MEASUREMENTS
from sentrymill.sources.tables import scratch, table


def display_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contacts").where("username IS NOT NULL")
    return c.select("id", sc.polynomial_hash(F.col("username")).alias("hash"), sc.display_code(F.col("username"), "CODE").alias("code"), sc.prefixed("user", F.col("id")).alias("key"))


def time_formats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("ts IS NOT NULL")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return f.select("feed_id", sc.iso_time(F.col("ts")).alias("iso"), sc.elapsed(seconds % 4000).alias("elapsed"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def signal_levels(spark: SparkSession, d: str) -> DataFrame:
    """Wireless, ping and clock outputs written from readings, and parsed again."""
    s = table(spark, d, "signals").where("snr_db IS NOT NULL AND latency_ms IS NOT NULL")
    pct, ch, ms = F.least(F.lit(100), F.floor(F.abs("snr_db") * 2)).cast("int"), (F.col("reading_id") % 40).cast("int"), F.floor("latency_ms").cast("int")
    text = F.format_string(
        "    SSID                   : %s\n    BSSID                  : 0a:1b:%02x\n    Channel                : %d\n    Signal                 : %d%%\nReply: time=%dms\nReply: time<%dms\nPhase Offset: -%d.5s\n",
        F.coalesce("source_id", F.lit("x")), (F.col("reading_id") % 256).cast("int"), ch, pct, ms, ms + 4, ms,
    )
    out = sc.link_reading(F.col("t")) | sc.ping_reading(F.col("t")) | {"drift_ms": sc.clock_drift(F.col("t"))}
    return s.select("reading_id", text.alias("t")).select("reading_id", *[c.alias(n) for n, c in out.items()])


def request_defaulting(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed")
    out = sc.request_defaults(F.col("total_packets"), F.col("total_bytes"), F.col("duration_ms"), F.when(F.col("protocol") == 6, F.col("total_packets")), F.lit(None).cast("double"))
    return f.select("feed_id", *[c.alias(n) for n, c in out.items()])


def vector_build(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "combined_dataset")
    v = scoring.vector(c.columns, ["fwd_packets", "fwd_packets_log", "fwd_bytes_log", "absent", "absent_log"])
    return c.select("record_id", F.transform(v, lambda x: F.round(x, 6)).alias("v")).select("record_id", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(5)])


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    sc.register_functions(spark)
    f = table(spark, d, "feed")
    return f.select("feed_id", F.call_function("threat_level", "malicious_probability").alias("level"), F.call_function("clip_to", F.col("total_bytes"), F.lit(100.0), F.lit(5000.0)).alias("clipped"),
                    F.round(F.call_function("safe_ratio", F.col("total_bytes"), F.col("total_packets").cast("double")), 6).alias("ratio"))


def bandit_reward(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("malicious_probability IS NOT NULL")
    r = sc.reward(F.col("malicious_probability"), 1 - F.col("malicious_probability"), F.col("malicious_probability") > 0.9)
    return f.select("feed_id", F.round(r, 6).alias("reward"))


def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """Gram matrix of the embeddings' dimensions: transpose times matrix."""
    m = matrices.from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    p = matrices.product(matrices.transposed(m), m)
    return p.select("i", "j", F.round("v", 4).alias("v"))


def tensor_sums(spark: SparkSession, d: str) -> DataFrame:
    t = matrices.axis_sums(table(spark, d, "embeddings"), "embedding")
    return t.select("pos", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def autoencoder_errors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    model = matrices.fit_on_all(e, "embedding", epochs=60)
    return matrices.reconstruction_errors(model, e, "vec_id", "embedding").select("vec_id", F.round("error", 6).alias("error"))


def _strokes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    down = e.select("user_id", F.col("event_type").alias("key"), F.lit("down").alias("kind"), us.alias("at"), "event_id")
    up = e.where("event_type <> 'error'").select("user_id", F.col("event_type").alias("key"), F.lit("up").alias("kind"), (us + F.floor(F.col("value") * 1000)).alias("at"), "event_id")
    return typing_rhythm.strokes(down.unionByName(up), ["user_id"], ["event_id"])


def keystroke_times(spark: SparkSession, d: str) -> DataFrame:
    return _strokes(spark, d).select("user_id", "event_id", "dwell", "flight")


def keystroke_digraphs(spark: SparkSession, d: str) -> DataFrame:
    g = typing_rhythm.digraphs(_strokes(spark, d), ["user_id"], ["event_id"])
    return g.select("user_id", F.posexplode("digraphs").alias("pos", "gap"))


def message_normalization(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("id IS NOT NULL")
    raw = m.select("id", F.when(F.col("delivery_id") % 3 == 0, F.lit(" ")).otherwise(F.col("sender")).alias("sender"), F.col("sender").alias("sender_id"), "text", F.col("self_destruct").cast("string").alias("self_destruct"),
                   F.when(F.col("delivery_id") % 5 == 0, F.lit("soon")).otherwise(F.col("destruct_timer").cast("string")).alias("destruct_timer"))
    return chat.incoming(raw)


def role_permissions(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("role"), (F.col("c_nationkey") % 4).alias("permission"))
    roles = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") < 12, "building").otherwise("machinery").alias("role"), (F.col("s_nationkey") % 3).alias("permission"))
    return chat.permitted(asked, roles).select("c_custkey", "role", "permission")


def event_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "signals").select("reading_id", "ts")
    feed = table(spark, d, "feed").select((F.col("feed_id") - 1).alias("pos"), "ts").where("ts IS NOT NULL")
    return chat.overridden(rows, ["reading_id"], feed).select("reading_id", "pos", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def model_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model predicts the same after it was saved and loaded."""
    c = table(spark, d, "combined_dataset")
    train, test = (learn.assembled(c.where(x), MEASUREMENTS, "label_binary", "record_id") for x in ("split = 'train'", "split = 'valid'"))
    fitted = learn.fitted("decision_tree", train)
    loaded = learn.saved(fitted, scratch(spark, "model"))
    again = loaded.transform(fitted.transform(test).select("record_id", "label", "features", F.col("prediction").alias("before")))
    return again.select("record_id", "label", (F.col("before") == F.col("prediction")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        display_codes, time_formats, signal_levels, request_defaulting, vector_build, sql_functions, bandit_reward, matrix_product, tensor_sums, autoencoder_errors,
        keystroke_times, keystroke_digraphs, message_normalization, role_permissions, event_positions, model_round_trip,
    )
}

_STROKES = """
ev AS (SELECT user_id, event_type AS key, 'down' AS kind, epoch_us(ts) AS t0, event_id FROM events
       UNION ALL SELECT user_id, event_type, 'up', epoch_us(ts) + floor(value * 1000)::BIGINT, event_id FROM events WHERE event_type <> 'error'),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, key, kind ORDER BY t0, event_id) AS nth FROM ev),
s AS (SELECT d.user_id, d.event_id, d.t0 AS pressed, u.t0 AS released FROM n d LEFT JOIN n u ON u.kind = 'up' AND u.user_id = d.user_id AND u.key = d.key AND u.nth = d.nth WHERE d.kind = 'down')
"""

SQL = {
    "model_round_trip": "SELECT record_id, label_binary::DOUBLE AS label, true AS same FROM combined_dataset WHERE split = 'valid' AND label_binary IS NOT NULL",
    "display_codes": """WITH h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(username, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM contacts WHERE username IS NOT NULL)
SELECT id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash, 'CODE-' || substr(lpad(upper(to_hex(h % 2147483648)), 8, '0'), 1, 4) || '-' || substr(lpad(upper(to_hex(h % 2147483648)), 8, '0'), 5, 4) AS code, 'user:' || id AS key FROM h""",
    "time_formats": """SELECT feed_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, ((epoch_us(ts) // 1000000) % 4000 // 60) || 'm ' || ((epoch_us(ts) // 1000000) % 4000 % 60) || 's' AS elapsed, epoch_us(ts) // 1000 AS ms FROM feed WHERE ts IS NOT NULL""",
    "signal_levels": """SELECT reading_id, coalesce(source_id, 'x') AS ssid, '0a:1b:' || lpad(lower(to_hex(reading_id % 256)), 2, '0') AS bssid, (reading_id % 40)::INT AS channel, p AS signal_pct,
round(greatest(0, -100 + p / 2.0 - CASE WHEN reading_id % 40 > 14 THEN -90 ELSE -95 END), 1)::DOUBLE AS snr_db, (m + 2)::DOUBLE AS latency_ms, 2.0::DOUBLE AS jitter_ms, 50.0::DOUBLE AS packet_loss_pct, -(m * 1000 + 500)::DOUBLE AS drift_ms
FROM (SELECT reading_id, source_id, least(100, floor(abs(snr_db) * 2))::INT AS p, floor(latency_ms)::INT AS m FROM signals WHERE snr_db IS NOT NULL AND latency_ms IS NOT NULL)""",
    "request_defaulting": """SELECT feed_id, coalesce(duration_ms, 1000.0) * 1000 AS flow_duration, coalesce(CASE WHEN protocol = 6 THEN total_packets END::DOUBLE, coalesce(total_packets, 0) / 2) AS total_fwd_packets,
coalesce(total_packets, 0) / 2 AS total_bwd_packets, coalesce(total_bytes, 0) / 2 AS total_length_fwd_packets, coalesce(total_bytes, 0) / 2 AS total_length_bwd_packets FROM feed""",
    "vector_build": """SELECT record_id, coalesce(fwd_packets, 0)::DOUBLE AS v0, round(coalesce(ln(1 + greatest(fwd_packets, 0)), 0), 6) AS v1, round(coalesce(ln(1 + greatest(fwd_bytes, 0)), 0), 6) AS v2, 0.0::DOUBLE AS v3, 0.0::DOUBLE AS v4 FROM
(SELECT record_id, fwd_packets, fwd_bytes FROM combined_dataset)""",
    "sql_functions": """SELECT feed_id, CASE WHEN p < 0.35 THEN 'safe' WHEN p < 0.55 THEN 'low' WHEN p < 0.75 THEN 'medium' WHEN p IS NOT NULL THEN 'critical' END AS level, greatest(100.0::DOUBLE, least(5000.0::DOUBLE, total_bytes)) AS clipped,
round(coalesce(total_bytes / nullif(total_packets, 0), 0), 6) AS ratio FROM (SELECT *, malicious_probability AS p FROM feed)""",
    "bandit_reward": "SELECT feed_id, round(CASE WHEN p > 0.9 THEN -100 ELSE (1 - p) * 10 - p END, 6)::DOUBLE AS reward FROM (SELECT feed_id, malicious_probability AS p FROM feed WHERE malicious_probability IS NOT NULL)",
    "matrix_product": """WITH m AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM m a JOIN m b USING (vec_id) GROUP BY 1, 2""",
    "tensor_sums": """WITH m AS (SELECT unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT pos, round(sum(v), 4) AS total, round(avg(v), 6) AS mean FROM m GROUP BY 1""",
    "keystroke_times": f"""WITH {_STROKES} SELECT user_id, event_id, released - pressed AS dwell, pressed - lag(released) OVER (PARTITION BY user_id ORDER BY pressed, event_id) AS flight FROM s""",
    "keystroke_digraphs": f"""WITH {_STROKES}, g AS (SELECT user_id, row_number() OVER w - 1 AS pos, coalesce(lead(pressed) OVER w - released, 0) AS gap, lead(pressed) OVER w AS nx FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pressed, event_id)),
u AS (SELECT DISTINCT user_id, unnest(range(5)) AS pos FROM g WHERE nx IS NOT NULL) SELECT u.user_id, u.pos::INT AS pos, coalesce(g.gap, 0) AS gap FROM u LEFT JOIN g ON g.user_id = u.user_id AND g.pos = u.pos AND g.nx IS NOT NULL""",
    "message_normalization": """SELECT nullif(trim(id), '') AS id, nullif(trim(sender), '') AS sender, coalesce(text, '') AS text, coalesce(self_destruct, false) AS self_destruct,
CASE WHEN delivery_id % 5 = 0 THEN 0 ELSE coalesce(destruct_timer, 0) END AS destruct_timer FROM messages WHERE id IS NOT NULL""",
    "role_permissions": """SELECT c_custkey, lower(c_mktsegment) AS role, c_nationkey % 4 AS permission FROM customer WHERE (lower(c_mktsegment), c_nationkey % 4) IN (SELECT CASE WHEN s_nationkey < 12 THEN 'building' ELSE 'machinery' END, s_nationkey % 3 FROM supplier)""",
    "event_positions": """SELECT r.reading_id, r.pos, epoch_us(coalesce(f.ts, r.ts)) AS us FROM (SELECT reading_id, ts, row_number() OVER (ORDER BY reading_id) - 1 AS pos FROM signals) r LEFT JOIN feed f ON f.feed_id - 1 = r.pos AND f.ts IS NOT NULL""",
}

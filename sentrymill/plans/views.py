"""Test tables as the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.sources.tables import table

GAP_SECONDS = 6 * 3600
MEASUREMENTS = (
    "duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_pkt_len_max", "fwd_pkt_len_std", "bwd_pkt_len_max",
    "bwd_pkt_len_std", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "fwd_iat_mean", "bwd_iat_mean", "init_fwd_win_bytes", "active_mean",
)


def packets(spark: SparkSession, d: str) -> DataFrame:
    """events as packets between a user and one server; views and clicks go out, other types come back."""
    return packets_of(table(spark, d, "events"))


def packets_of(e: DataFrame) -> DataFrame:
    out = F.col("event_type").isin("view", "click")
    user = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256), F.lit("."), F.col("user_id") % 256)
    port, server, service = (F.lit(20_000) + F.col("user_id") % 1000).cast("int"), F.lit("192.0.2.1"), F.lit(443)
    flags = (
        F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 17).when(F.col("event_type") == "click", 24).otherwise(16)
    )
    tcp = F.col("user_id") % 3 != 0
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.when(out, user).otherwise(server).alias("src_ip"),
        F.when(out, server).otherwise(user).alias("dst_ip"),
        F.when(out, port).otherwise(service).alias("src_port"),
        F.when(out, service).otherwise(port).alias("dst_port"),
        F.when(tcp, 6).otherwise(17).alias("protocol"),
        F.floor("value").cast("int").alias("length"),
        F.when(tcp, flags).otherwise(0).alias("flags"),
        F.when(tcp, F.get_json_object("props", "$.k").cast("int")).otherwise(0).alias("win"),
        out.alias("outgoing"),
    )


PACKETS_SQL = """
pk AS (
  SELECT event_id AS seq, ts, user_id, event_type IN ('view', 'click') AS outgoing,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS u, 20000 + user_id % 1000 AS up,
         CASE WHEN user_id % 3 <> 0 THEN 6 ELSE 17 END AS protocol, CAST(floor(value) AS INTEGER) AS length,
         CASE WHEN user_id % 3 = 0 THEN 0 WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' THEN 17 WHEN event_type = 'click' THEN 24 ELSE 16 END AS flags,
         CASE WHEN user_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) ELSE 0 END AS win
  FROM events),
packets AS (
  SELECT seq, ts, user_id, outgoing, protocol, length, flags, win, epoch_us(ts) AS us,
         CASE WHEN outgoing THEN u ELSE '192.0.2.1' END AS src_ip, CASE WHEN outgoing THEN '192.0.2.1' ELSE u END AS dst_ip,
         CASE WHEN outgoing THEN up ELSE 443 END AS src_port, CASE WHEN outgoing THEN 443 ELSE up END AS dst_port
  FROM pk)
"""

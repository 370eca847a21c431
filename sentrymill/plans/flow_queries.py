"""Queries over packets and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.functions.stats import ladder
from sentrymill.operators import flows as fl
from sentrymill.plans.views import GAP_SECONDS, PACKETS_SQL, packets


def _rounded(df: DataFrame, digits: int, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`").alias(n) for n, t in df.dtypes]
    )


def _sessions(spark: SparkSession, d: str, terminators: bool) -> DataFrame:
    t = fl.flow_table(packets(spark, d), GAP_SECONDS, terminators)
    return t.select("pair", "segment", "src_ip", "src_port", "start_us", "last_us", F.col("n_all").alias("packets"), "n_fwd", "n_bwd", "close_reason")


def flow_sessions_gap(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d, False)


def flow_sessions_terminated(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d, True)


def flow_sessions_native(spark: SparkSession, d: str) -> DataFrame:
    p = fl.with_pair(packets(spark, d))
    return p.groupBy("pair", F.session_window("ts", f"{GAP_SECONDS} seconds").alias("w")).agg(F.count("*").alias("packets")).select(
        "pair", fl.micros(F.col("w.start")).alias("start_us"), "packets"
    )


def flow_features_100(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fl.flow_features(fl.emitted(fl.flow_table(packets(spark, d), GAP_SECONDS))), 4)


def flow_iat_stats(spark: SparkSession, d: str) -> DataFrame:
    t = fl.flow_table(packets(spark, d), GAP_SECONDS)
    return _rounded(t.select("pair", "segment", *[f"{s}_iat_{x}" for s in ("fwd", "bwd", "flow") for x in ("mean", "std", "min", "max", "total")]), 3)


def flow_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    t = fl.flow_table(packets(spark, d), GAP_SECONDS)
    return t.select("pair", "segment", "fin", "rst", "psh", "ack", "urg", "fwd_psh", "fwd_urg", "fwd_win", "bwd_win")


def flow_tap_stats(spark: SparkSession, d: str) -> DataFrame:
    t = fl.flow_tap(packets(spark, d))
    return t.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", fl.micros("first_seen").alias("first_us"), fl.micros("last_seen").alias("last_us"))


def flow_tap_expiry(spark: SparkSession, d: str) -> DataFrame:
    tap = fl.flow_tap(packets(spark, d))
    kept = fl.unexpired(tap, F.lit("2024-01-31 00:00:00").cast("timestamp"), 86_400)
    return kept.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", fl.micros("last_seen").alias("last_us"))


def flow_scored_feed(spark: SparkSession, d: str) -> DataFrame:
    """A linear stand-in score over the features, laddered and newest first."""
    f = fl.flow_table(packets(spark, d), GAP_SECONDS)
    score = F.round(F.least(F.lit(1.0), (F.col("rst") * 0.3 + F.col("fin") * 0.1 + F.col("n_all") * 0.02)), 4)
    scored = f.withColumn("malicious_probability", score)
    return (
        scored.withColumn("classification", ladder(F.col("malicious_probability"), (0.35, "Normal"), (0.55, "Suspicious"), (0.75, "Malicious"), last="Critical"))
        .withColumn("threat_level", ladder(F.col("malicious_probability"), (0.35, "safe"), (0.55, "low"), (0.75, "medium"), last="critical"))
        .orderBy(F.desc("last_us"), "pair", "segment")
        .limit(20)
        .select("pair", "segment", "last_us", "malicious_probability", "classification", "threat_level", F.round((F.col("last_us") - F.col("start_us")) / 1000, 2).alias("duration_ms"))
    )


def rolling_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    r = fl.rolling_rate(packets(spark, d), ["user_id"], 6 * 3600)
    return r.select("seq", F.round("packets_per_s", 8).alias("packets_per_s"), F.round("bytes_per_s", 6).alias("bytes_per_s"))


def burst_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fl.bursts(packets(spark, d), ["user_id"], 2 * 3600 * 1_000_000), 6)


def detector_vector(spark: SparkSession, d: str) -> DataFrame:
    v = fl.detector_vector(packets(spark, d), ["user_id"], 2 * 3600 * 1_000_000)
    return v.select("user_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        flow_sessions_gap, flow_sessions_terminated, flow_sessions_native, flow_features_100, flow_iat_stats, flow_flag_counts, flow_tap_stats,
        flow_tap_expiry, flow_scored_feed, rolling_bandwidth, burst_stats, detector_vector,
    )
}

_SEG = f"""{PACKETS_SQL},
paired AS (
  SELECT *, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '-' || greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '-' || protocol AS pair,
         (protocol = 6 AND (flags & 5) <> 0) AS term FROM packets),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w > {GAP_SECONDS}::BIGINT * 1000000 THEN 1 ELSE 0 END AS by_gap,
         CASE WHEN lag(term) OVER w THEN 1 ELSE 0 END AS by_end FROM paired WINDOW w AS (PARTITION BY pair ORDER BY us, seq))
"""


def _seg(opened: str) -> str:
    return f"""{_SEG},
segd AS (SELECT *, CAST(sum({opened}) OVER (PARTITION BY pair ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM marked),
dir AS (SELECT *, (src_ip || ':' || src_port) = first_value(src_ip || ':' || src_port) OVER (PARTITION BY pair, segment ORDER BY us, seq) AS is_fwd FROM segd),
gaps AS (
  SELECT *, CAST(us - lag(us) OVER (PARTITION BY pair, segment, is_fwd ORDER BY us, seq) AS DOUBLE) AS gd,
         CAST(us - lag(us) OVER (PARTITION BY pair, segment ORDER BY us, is_fwd DESC, seq) AS DOUBLE) AS gf FROM dir)
"""


def ended_segments() -> str:
    """The packets and their segments by gap, FIN and RST, as ``segd``."""
    return _seg(_BY_END)


def _sessions_sql(opened: str, reason: str) -> str:
    return f"""WITH {_seg(opened)}
SELECT pair, segment, arg_min(src_ip, (us, seq)) AS src_ip, arg_min(src_port, (us, seq)) AS src_port, min(us) AS start_us, max(us) AS last_us, count(*) AS packets,
       count(*) FILTER (is_fwd) AS n_fwd, count(*) FILTER (NOT is_fwd) AS n_bwd, {reason} AS close_reason FROM gaps GROUP BY 1, 2"""


_BY_END = "greatest(by_gap, by_end)"


def _stats(name: str, value: str, cond: str | None = None) -> str:
    f = f" FILTER ({cond})" if cond else ""
    return ", ".join(
        f"coalesce({fn}({value}){f}, 0.0) AS {name}_{out}"
        for fn, out in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"), ("sum", "total"))
    )


_AGG = f"""{_seg(_BY_END)},
agg AS (
  SELECT pair, segment, arg_min(src_port, (us, seq)) AS sp, arg_min(dst_port, (us, seq)) AS dp, arg_min(protocol, (us, seq)) AS pr,
         min(us) AS start_us, max(us) AS last_us, count(*) AS n, count(*) FILTER (is_fwd) AS nf, count(*) FILTER (NOT is_fwd) AS nb,
         {_stats("f", "length::DOUBLE", "is_fwd")}, {_stats("b", "length::DOUBLE", "NOT is_fwd")}, {_stats("a", "length::DOUBLE")},
         {_stats("fi", "gd", "is_fwd")}, {_stats("bi", "gd", "NOT is_fwd")}, {_stats("li", "gf")},
         count(*) FILTER ((flags & 1) <> 0) AS fin, count(*) FILTER ((flags & 4) <> 0) AS rst, count(*) FILTER ((flags & 8) <> 0) AS psh,
         count(*) FILTER ((flags & 16) <> 0) AS ack, count(*) FILTER ((flags & 32) <> 0) AS urg,
         count(*) FILTER (is_fwd AND (flags & 8) <> 0) AS fpsh, count(*) FILTER (is_fwd AND (flags & 32) <> 0) AS furg,
         greatest(coalesce(arg_min(win, (us, seq)) FILTER (is_fwd), 0), 0) AS fw, greatest(coalesce(arg_min(win, (us, seq)) FILTER (NOT is_fwd), 0), 0) AS bw
  FROM gaps GROUP BY 1, 2),
x AS (SELECT *, greatest((last_us - start_us)::DOUBLE, 1.0) AS du, greatest((last_us - start_us)::DOUBLE, 1.0) / 1e6 AS ds, f_total + b_total AS tb FROM agg)
"""

#: Feature name and formula, in the fixed order.
_FEATURES = [
    ("src_port", "sp"), ("dst_port", "dp"), ("protocol", "pr"), ("flow_duration", "du"), ("total_fwd_packets", "nf"), ("total_bwd_packets", "nb"),
    ("total_length_fwd_packets", "f_total"), ("total_length_bwd_packets", "b_total"),
    *[(f"{n}_pkt_len_{s}", f"{k}_{s}") for n, k in (("fwd", "f"), ("bwd", "b")) for s in ("max", "min", "mean", "std")],
    ("flow_bytes_per_sec", "tb / ds"), ("flow_packets_per_sec", "n / ds"), ("flow_iat_mean", "li_mean"), ("flow_iat_std", "li_std"), ("flow_iat_max", "li_max"),
    ("fwd_iat_mean", "fi_mean"), ("fwd_iat_std", "fi_std"), ("fwd_iat_min", "fi_min"), *[(f"bwd_iat_{s}", f"bi_{s}") for s in ("total", "mean", "std", "max", "min")],
    ("fwd_psh_flags", "fpsh"), ("fwd_urg_flags", "furg"), ("bwd_header_length", "20 * nb"), ("fwd_packets_per_sec", "nf / ds"), ("bwd_packets_per_sec", "nb / ds"),
    ("pkt_len_min", "a_min"), ("pkt_len_max", "a_max"), ("pkt_len_mean", "a_mean"), ("pkt_len_std", "a_std"), ("pkt_len_var", "a_std * a_std"),
    *[(f"{f}_flag_cnt", f) for f in ("fin", "rst", "psh", "ack", "urg")],
    ("down_up_ratio", "nb::DOUBLE / (nf + 1)"), ("bwd_packets_bulk_avg", "nb"), ("bwd_bulk_rate_avg", "b_total / (ds + 1e-9)"), ("subflow_fwd_bytes", "f_total"),
    ("subflow_bwd_packets", "nb"), ("init_fwd_win_bytes", "fw"), ("init_bwd_win_bytes", "bw"), ("fwd_seg_size_min", "f_min"),
    *[(n, "0") for n in ("active_mean", "active_std", "active_max", "active_min", "idle_mean", "idle_std", "idle_min", "service", "state")],
    ("rate", "n / ds"), ("bwd_bytes_per_sec", "b_total / (ds + 1e-9)"), ("sloss", "rst"),
    *[(n, "0") for n in ("stcpb", "dtcpb", "tcprtt", "synack", "ackdat", "trans_depth")],
    ("response_body_len", "b_total"), ("ct_src_dport_ltm", "1"), ("ct_dst_sport_ltm", "1"), ("is_ftp_login", "(dp IN (20, 21))::INT"),
    ("ct_flw_http_mthd", "(dp IN (80, 443, 8080, 8443))::INT"), ("flow_bytes/s", "tb / ds"), ("fin_flag_count", "fin"), ("init_win_bytes_forward", "fw"),
    ("fwd_packet_fraction", "nf::DOUBLE / (n + 1)"), ("total_bytes", "tb"), ("fwd_bytes_fraction", "f_total / (tb + 1)"), ("bytes_per_second", "tb / (ds + 1e-9)"),
    ("payload_ratio", "f_mean / (b_mean + 1)"), ("payload_diff", "f_mean - b_mean"), ("iat_cv", "li_std / (li_mean + 1e-9)"),
    ("is_well_known_port", "(dp < 1024)::INT"), ("is_http_port", "(dp IN (80, 443, 8080, 8443))::INT"), ("is_dns_port", "(dp = 53)::INT"),
    *[(f"{n}_log", f"ln(1 + greatest({e}, 0))") for n, e in (("dst_port", "dp"), ("flow_duration", "du"), ("total_fwd_packets", "nf"), ("total_bwd_packets", "nb"),
      ("total_length_fwd_packets", "f_total"), ("total_length_bwd_packets", "b_total"), ("total_bytes", "tb"), ("total_packets", "n"))],
    *[(f"dataset_onehot_{i}", "0") for i in range(4)],
]

SQL = {
    "flow_sessions_gap": _sessions_sql("by_gap", "'idle'"),
    "flow_sessions_terminated": _sessions_sql(_BY_END, "CASE WHEN arg_max(term, (us, seq)) THEN 'fin_rst' ELSE 'idle' END"),
    "flow_sessions_native": f"WITH {_seg('by_gap')} SELECT pair, min(us) AS start_us, count(*) AS packets FROM segd GROUP BY pair, segment",
    "flow_features_100": f"WITH {_AGG} SELECT pair, segment, " + ", ".join(f'round(({e})::DOUBLE, 4) AS "{n}"' for n, e in _FEATURES) + " FROM x",
    "flow_iat_stats": f"WITH {_AGG} SELECT pair, segment, "
    + ", ".join(f"round({k}_{s}, 3) AS {n}_iat_{s}" for n, k in (("fwd", "fi"), ("bwd", "bi"), ("flow", "li")) for s in ("mean", "std", "min", "max", "total"))
    + " FROM x",
    "flow_flag_counts": f"WITH {_AGG} SELECT pair, segment, fin, rst, psh, ack, urg, fpsh AS fwd_psh, furg AS fwd_urg, fw AS fwd_win, bw AS bwd_win FROM x",
    "flow_tap_stats": f"""WITH {PACKETS_SQL} SELECT src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(us) AS first_us, max(us) AS last_us
FROM packets GROUP BY 1, 2, 3, 4, 5""",
    "flow_tap_expiry": f"""WITH {PACKETS_SQL} SELECT src_ip, dst_ip, src_port, dst_port, protocol, max(us) AS last_us FROM packets GROUP BY 1, 2, 3, 4, 5
HAVING epoch_us(TIMESTAMP '2024-01-31 00:00:00') - max(us) < 86400000000""",
    "flow_scored_feed": f"""WITH {_AGG}, s AS (SELECT *, round(least(1.0, rst * 0.3 + fin * 0.1 + n * 0.02)::DOUBLE, 4) AS p FROM x)
SELECT pair, segment, last_us, p AS malicious_probability,
       CASE WHEN p < 0.35 THEN 'Normal' WHEN p < 0.55 THEN 'Suspicious' WHEN p < 0.75 THEN 'Malicious' ELSE 'Critical' END AS classification,
       CASE WHEN p < 0.35 THEN 'safe' WHEN p < 0.55 THEN 'low' WHEN p < 0.75 THEN 'medium' ELSE 'critical' END AS threat_level,
       round((last_us - start_us) / 1000, 2) AS duration_ms FROM s ORDER BY last_us DESC, pair, segment LIMIT 20""",
    "rolling_bandwidth": f"""WITH {PACKETS_SQL} SELECT seq, round(count(*) OVER w / 21600.0, 8) AS packets_per_s, round(sum(length) OVER w / 21600.0, 6) AS bytes_per_s FROM packets
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)""",
    "burst_stats": f"""WITH {PACKETS_SQL},
m AS (SELECT *, CASE WHEN us - lag(us) OVER w < 7200000000 THEN 0 ELSE 1 END AS fresh FROM packets WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run FROM m),
s AS (SELECT user_id, run, count(*) AS size, max(us) - min(us) AS dur FROM r GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (size > 1) AS bursts, round(coalesce(avg(size) FILTER (size > 1), 0), 6) AS avg_size, coalesce(max(size) FILTER (size > 1), 0) AS max_size,
       CAST(coalesce(sum(dur) FILTER (size > 1), 0) AS BIGINT) AS total_duration FROM s GROUP BY 1""",
    "detector_vector": f"""WITH {PACKETS_SQL},
m AS (SELECT *, us - lag(us) OVER w AS gap, CASE WHEN us - lag(us) OVER w < 7200000000 THEN 0 ELSE 1 END AS fresh FROM packets WINDOW w AS (PARTITION BY user_id ORDER BY us, seq)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run FROM m),
s AS (SELECT user_id, run, count(*) AS size FROM r GROUP BY 1, 2),
b AS (SELECT user_id, count(*) FILTER (size > 1) AS bursts, avg(size) FILTER (size > 1) AS avg_size FROM s GROUP BY 1),
p AS (SELECT user_id, avg(length) AS me, max(length) AS mx, min(length) AS mn, avg(gap) AS g, avg(outgoing::INT) AS o FROM m GROUP BY 1)
SELECT user_id, 5 + (g IS NOT NULL)::INT + (avg_size IS NOT NULL)::INT AS n,
       round(me + mx + mn + coalesce(g, 0) + bursts + coalesce(avg_size, 0) + o, 3) AS total FROM p JOIN b USING (user_id)""",
}

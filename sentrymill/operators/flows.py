"""Packets to bidirectional flows, and flows to a fixed set of 100 features.

A flow is a run of packets between two endpoints that ends with an idle gap (strictly longer than the
limit) or after a TCP packet with FIN or RST; the next packet opens a new flow, whose forward direction
is that of its own first packet. Packets are ordered by (ts, seq); all statistics are population ones
and 0.0 when empty. Everything is window functions over the pair of endpoints and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.functions.stats import safe_stats

FIN, RST, PSH, ACK, URG = 1, 4, 8, 16, 32
TCP, UDP = 6, 17
HTTP_PORTS = (80, 443, 8080, 8443)
FTP_PORTS = (20, 21)
FLOW = ["pair", "segment"]
ENDPOINTS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def parsed_packets(raw: DataFrame) -> DataFrame:
    """Keeps IP packets; ports count only for TCP and UDP, flags and window only for TCP."""
    tcp, ported = F.col("protocol") == TCP, F.col("protocol").isin(TCP, UDP)
    only = lambda c, cond: F.when(cond, F.col(c)).otherwise(F.lit(0))
    return raw.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).withColumns(
        {"src_port": only("src_port", ported), "dst_port": only("dst_port", ported), "flags": only("flags", tcp), "win": only("win", tcp)}
    )


def with_pair(packets: DataFrame) -> DataFrame:
    """Adds ``pair``, the same for both directions."""
    a, b = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    return packets.withColumn("pair", F.concat_ws("-", F.least(a, b), F.greatest(a, b), F.col("protocol").cast("string")))


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def segmented(packets: DataFrame, gap_seconds: float, terminators: bool = True) -> DataFrame:
    """Adds pair, segment (0, 1, ... per pair) and is_fwd to every packet."""
    order = Window.partitionBy("pair").orderBy("us", "seq")
    ends = (F.col("protocol") == TCP) & (F.col("flags").bitwiseAND(FIN | RST) != 0) if terminators else F.lit(False)
    idle = F.col("us") - F.lag("us").over(order) > int(gap_seconds * 1_000_000)
    opened = F.coalesce(idle | F.lag("ends").over(order), F.lit(False)).cast("int")
    first = Window.partitionBy(*FLOW).orderBy("us", "seq")
    source = F.concat_ws(":", "src_ip", "src_port")
    return (
        with_pair(packets)
        .withColumns({"us": micros("ts"), "ends": ends})
        .withColumn("opened", opened)
        .withColumn("segment", F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"is_fwd": source == F.first(source).over(first)} | {f"first_{c}": F.first(c).over(first) for c in ENDPOINTS})
        .drop("opened")
    )


def with_gaps(packets: DataFrame) -> DataFrame:
    """Adds the gap in microseconds to the packet before: in the same direction, and in the flow."""
    same = Window.partitionBy(*FLOW, "is_fwd").orderBy("us", "seq")
    merged = Window.partitionBy(*FLOW).orderBy("us", F.desc("is_fwd"), "seq")
    return packets.withColumns(
        {
            "first_win": F.first("win").over(same),
            "gap_dir": (F.col("us") - F.lag("us").over(same)).cast("double"),
            "gap_flow": (F.col("us") - F.lag("us").over(merged)).cast("double"),
        }
    )


def flow_table(packets: DataFrame, gap_seconds: float, terminators: bool = True) -> DataFrame:
    """One row per flow: endpoints of the first packet, times, close reason and the base statistics.

    What the first packets have comes from the windows, so that only numbers are aggregated, by hash.
    """
    p = with_gaps(segmented(packets, gap_seconds, terminators))
    fwd, bwd = F.col("is_fwd"), ~F.col("is_fwd")
    flag = lambda m: F.count_if(F.col("flags").bitwiseAND(m) != 0)
    length = F.col("length").cast("double")
    aggs: dict[str, Column] = {"start_us": F.min("us"), "last_us": F.max("us"), "n_fwd": F.count_if(fwd), "n_bwd": F.count_if(bwd), "n_all": F.count("*")}
    aggs |= {"ended": F.max(F.col("ends").cast("int")) == 1}
    for name, value in (
        ("fwd", F.when(fwd, length)),
        ("bwd", F.when(bwd, length)),
        ("all", length),
        ("fwd_iat", F.when(fwd, F.col("gap_dir"))),
        ("bwd_iat", F.when(bwd, F.col("gap_dir"))),
        ("flow_iat", F.col("gap_flow")),
    ):
        aggs |= safe_stats(value, name)
    aggs |= {n: flag(m) for n, m in (("fin", FIN), ("rst", RST), ("psh", PSH), ("ack", ACK), ("urg", URG))}
    aggs |= {
        "fwd_psh": F.count_if(fwd & (F.col("flags").bitwiseAND(PSH) != 0)),
        "fwd_urg": F.count_if(fwd & (F.col("flags").bitwiseAND(URG) != 0)),
        "fwd_win": F.greatest(F.coalesce(F.max(F.when(fwd, F.col("first_win"))), F.lit(0)), F.lit(0)),
        "bwd_win": F.greatest(F.coalesce(F.max(F.when(bwd, F.col("first_win"))), F.lit(0)), F.lit(0)),
    }
    whole = p.groupBy(*FLOW, *[F.col(f"first_{c}").alias(c) for c in ENDPOINTS]).agg(*[c.alias(n) for n, c in aggs.items()])
    return whole.select(*FLOW, *ENDPOINTS, *aggs).withColumn(
        "close_reason", F.when(F.col("ended"), F.lit("fin_rst")).otherwise(F.lit("idle"))
    )


def flow_features(flows: DataFrame) -> DataFrame:
    """The 100 features of each flow of ``flow_table``, as doubles in their fixed order after the flow's key."""
    c, d, zero = F.col, (lambda x: F.col(x).cast("double")), F.lit(0.0)
    flows = flows.withColumn("dur_us", F.greatest((c("last_us") - c("start_us")).cast("double"), F.lit(1.0)))
    flows = flows.withColumns({"dur_s": c("dur_us") / 1e6, "bytes": c("fwd_total") + c("bwd_total")})
    per_s = lambda x: x / c("dur_s")
    per_s_soft = lambda x: x / (c("dur_s") + 1e-9)
    log = lambda x: F.log1p(F.greatest(x, zero))
    is_in = lambda ports: c("dst_port").isin(*ports).cast("double")
    features: dict[str, Column] = {
        "src_port": d("src_port"), "dst_port": d("dst_port"), "protocol": d("protocol"), "flow_duration": c("dur_us"),
        "total_fwd_packets": d("n_fwd"), "total_bwd_packets": d("n_bwd"), "total_length_fwd_packets": c("fwd_total"), "total_length_bwd_packets": c("bwd_total"),
    }
    for side in ("fwd", "bwd"):
        features |= {f"{side}_pkt_len_{s}": c(f"{side}_{s}") for s in ("max", "min", "mean", "std")}
    features |= {"flow_bytes_per_sec": per_s(c("bytes")), "flow_packets_per_sec": per_s(d("n_all"))}
    features |= {f"flow_iat_{s}": c(f"flow_iat_{s}") for s in ("mean", "std", "max")}
    features |= {f"fwd_iat_{s}": c(f"fwd_iat_{s}") for s in ("mean", "std", "min")}
    features |= {f"bwd_iat_{s}": c(f"bwd_iat_{s}") for s in ("total", "mean", "std", "max", "min")}
    features |= {"fwd_psh_flags": d("fwd_psh"), "fwd_urg_flags": d("fwd_urg"), "bwd_header_length": d("n_bwd") * 20}
    features |= {"fwd_packets_per_sec": per_s(d("n_fwd")), "bwd_packets_per_sec": per_s(d("n_bwd"))}
    features |= {f"pkt_len_{s}": c(f"all_{s}") for s in ("min", "max", "mean", "std")} | {"pkt_len_var": c("all_std") * c("all_std")}
    features |= {f"{f}_flag_cnt": d(f) for f in ("fin", "rst", "psh", "ack", "urg")}
    features |= {
        "down_up_ratio": d("n_bwd") / (c("n_fwd") + 1),
        "bwd_packets_bulk_avg": d("n_bwd"),
        "bwd_bulk_rate_avg": per_s_soft(c("bwd_total")),
        "subflow_fwd_bytes": c("fwd_total"),
        "subflow_bwd_packets": d("n_bwd"),
        "init_fwd_win_bytes": d("fwd_win"),
        "init_bwd_win_bytes": d("bwd_win"),
        "fwd_seg_size_min": c("fwd_min"),
    }
    features |= {n: zero for n in ("active_mean", "active_std", "active_max", "active_min", "idle_mean", "idle_std", "idle_min", "service", "state")}
    features |= {"rate": per_s(d("n_all")), "bwd_bytes_per_sec": per_s_soft(c("bwd_total")), "sloss": d("rst")}
    features |= {n: zero for n in ("stcpb", "dtcpb", "tcprtt", "synack", "ackdat", "trans_depth")}
    features |= {
        "response_body_len": c("bwd_total"),
        "ct_src_dport_ltm": F.lit(1.0),
        "ct_dst_sport_ltm": F.lit(1.0),
        "is_ftp_login": is_in(FTP_PORTS),
        "ct_flw_http_mthd": is_in(HTTP_PORTS),
        "flow_bytes/s": per_s(c("bytes")),
        "fin_flag_count": d("fin"),
        "init_win_bytes_forward": d("fwd_win"),
        "fwd_packet_fraction": c("n_fwd") / (d("n_all") + 1),
        "total_bytes": c("bytes"),
        "fwd_bytes_fraction": c("fwd_total") / (c("bytes") + 1),
        "bytes_per_second": per_s_soft(c("bytes")),
        "payload_ratio": c("fwd_mean") / (c("bwd_mean") + 1),
        "payload_diff": c("fwd_mean") - c("bwd_mean"),
        "iat_cv": c("flow_iat_std") / (c("flow_iat_mean") + 1e-9),
        "is_well_known_port": (c("dst_port") < 1024).cast("double"),
        "is_http_port": is_in(HTTP_PORTS),
        "is_dns_port": is_in((53,)),
        "dst_port_log": log(d("dst_port")),
        "flow_duration_log": log(c("dur_us")),
        "total_fwd_packets_log": log(d("n_fwd")),
        "total_bwd_packets_log": log(d("n_bwd")),
        "total_length_fwd_packets_log": log(c("fwd_total")),
        "total_length_bwd_packets_log": log(c("bwd_total")),
        "total_bytes_log": log(c("bytes")),
        "total_packets_log": log(d("n_all")),
    }
    features |= {f"dataset_onehot_{i}": zero for i in range(4)}
    return flows.select(*FLOW, *[x.alias(n) for n, x in features.items()])


def emitted(flows: DataFrame, min_packets: int = 1, min_duration_us: int = 0) -> DataFrame:
    return flows.where((F.col("n_all") >= min_packets) & (F.col("last_us") - F.col("start_us") >= min_duration_us))


def flow_tap(packets: DataFrame) -> DataFrame:
    """Directional 5-tuple counters: packets, bytes, first and last time."""
    return packets.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def unexpired(tap: DataFrame, now: Column, timeout_seconds: int) -> DataFrame:
    """Entries seen strictly less than the timeout ago."""
    return tap.where(micros(now) - micros("last_seen") < timeout_seconds * 1_000_000)


def rolling_rate(packets: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Per packet: packets and bytes of the last ``seconds``, lower bound excluded, divided by the constant window."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return packets.withColumn("us", micros("ts")).withColumns(
        {"packets_per_s": F.count("*").over(w) / float(seconds), "bytes_per_s": F.sum("length").over(w) / float(seconds)}
    )


def bursts(packets: DataFrame, keys: list[str], max_gap_us: int) -> DataFrame:
    """Runs of gaps below the limit; a run's size counts its first packet, single packets are no run."""
    order = Window.partitionBy(*keys).orderBy("us", "seq")
    gap = F.col("us") - F.lag("us").over(order)
    fresh = F.coalesce(gap >= max_gap_us, F.lit(True)).cast("int")
    runs = (
        packets.withColumn("us", micros("ts"))
        .withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "run")
        .agg(F.count("*").alias("size"), (F.max("us") - F.min("us")).alias("duration"))
    )
    in_run = F.col("size") > 1
    return runs.groupBy(*keys).agg(
        F.count_if(in_run).alias("bursts"),
        F.coalesce(F.avg(F.when(in_run, F.col("size"))), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.max(F.when(in_run, F.col("size"))), F.lit(0)).alias("max_size"),
        F.coalesce(F.sum(F.when(in_run, F.col("duration"))), F.lit(0)).alias("total_duration"),
    )


def detector_vector(packets: DataFrame, keys: list[str], max_gap_us: int) -> DataFrame:
    """Array of mean, max, min size, mean gap, bursts, mean burst size, outgoing share; values of empty lists are left out."""
    order = Window.partitionBy(*keys).orderBy("us", "seq")
    stats = (
        packets.withColumn("us", micros("ts"))
        .withColumn("gap", F.col("us") - F.lag("us").over(order))
        .groupBy(*keys)
        .agg(
            F.avg("length").alias("mean"), F.max("length").alias("max"), F.min("length").alias("min"),
            F.avg("gap").alias("gap"), F.avg(F.col("outgoing").cast("double")).alias("out"),
        )
    )
    both = stats.join(bursts(packets, keys, max_gap_us), keys)
    has = F.col("bursts") > 0
    values = ["mean", F.col("max").cast("double"), F.col("min").cast("double"), "gap", F.col("bursts").cast("double"), F.when(has, F.col("avg_size")), "out"]
    return both.select(*keys, F.filter(F.array(*values), lambda x: x.isNotNull()).alias("vector"))

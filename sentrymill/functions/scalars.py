"""Scalar functions: codes, hashes, times, signal readings from command output, request defaults, SQL registration."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_TWO32 = 4_294_967_296


def polynomial_hash(text: Column) -> Column:
    """The 32-bit signed hash s[0] * 31^(n-1) + ... + s[n-1] over UTF-16 units, as many runtimes define it for strings."""
    units = F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", "$1,"), ",")
    total = F.aggregate(
        F.filter(units, lambda u: u != ""), F.lit(0).cast("bigint"), lambda h, u: F.pmod(h * 31 + F.conv(u, 16, 10).cast("bigint"), F.lit(_TWO32))
    )
    return F.when(total >= _TWO32 // 2, total - _TWO32).otherwise(total)


def display_code(text: Column, prefix: str) -> Column:
    """prefix-XXXX-XXXX from the 31 low bits of the hash, in upper-case hex."""
    h = F.lpad(F.hex(polynomial_hash(text).bitwiseAND(0x7FFFFFFF)), 8, "0")
    return F.concat_ws("-", F.lit(prefix), F.substring(h, 1, 4), F.substring(h, 5, 4))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed(seconds: Column) -> Column:
    """``Xm Ys``."""
    return F.format_string("%dm %ds", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def prefixed(kind: str, key: Column, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(kind), key, *[F.lit(p) for p in parts])


def exponential(key: Column, mean: float, seed: int = 42) -> Column:
    """A sample of the exponential distribution by inverse transform of a hash of the key, in (0, inf)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) * mean


def snr_from_percent(percent: Column, high_band: Column) -> Column:
    """Signal percent to dB over the noise floor: -100 + percent / 2 dBm against -90 or -95 dBm, at least 0, one digit."""
    dbm = -100 + percent / 100.0 * 50
    return F.round(F.greatest(F.lit(0.0), dbm - F.when(high_band, F.lit(-90.0)).otherwise(F.lit(-95.0))), 1)


def link_reading(output: Column) -> dict[str, Column]:
    """Fields of a wireless status text; defaults where a line is missing."""
    found = lambda p, default: F.coalesce(F.nullif(F.trim(F.regexp_extract(output, p, 1)), F.lit("")), F.lit(default))
    channel = found(r"Channel\s*:\s*(\d+)", "0").cast("int")
    percent = found(r"Signal\s*:\s*(\d+)%", "70").cast("int")
    high = F.contains(F.lower(found(r"Radio type\s*:\s*(.+)", "")), F.lit("5ghz")) | (channel > 14)
    return {
        "ssid": found(r"\bSSID\s*:\s*(.+)", "Wi-Fi"),
        "bssid": found(r"BSSID\s*:\s*([0-9A-Fa-f:]+)", "?"),
        "channel": channel,
        "signal_pct": percent,
        "snr_db": snr_from_percent(percent, high),
    }


def ping_reading(output: Column, sent: int = 4) -> dict[str, Column]:
    """Mean round trip, population deviation about it and loss in percent of a ping's output; 999, 0 and 100 without answers."""
    rtts = F.transform(F.regexp_extract_all(output, F.lit(r"[Tt]ime[=<](\d+)\s*ms"), F.lit(1)), lambda x: x.cast("double"))
    n = F.size(rtts)
    mean = F.round(F.try_divide(F.aggregate(rtts, F.lit(0.0), lambda s, x: s + x), n), 1)
    spread = F.sqrt(F.try_divide(F.aggregate(rtts, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n))
    return {
        "latency_ms": F.coalesce(mean, F.lit(999.0)),
        "jitter_ms": F.when(n > 1, F.round(spread, 1)).otherwise(F.lit(0.0)),
        "packet_loss_pct": F.round((sent - n) / float(sent) * 100, 1),
    }


def clock_drift(output: Column) -> Column:
    """Phase offset, else root delay, of a time service's status in milliseconds; 0 without either."""
    of = lambda p: F.regexp_extract(output, p, 1).try_cast("double")
    seconds = F.coalesce(of(r"Phase Offset\s*:\s*(-?[\d.]+)s"), of(r"Root Delay\s*:\s*([\d.]+)s"), F.lit(0.0))
    return F.round(seconds * 1000, 2)


def request_defaults(packets: Column, total_bytes: Column, duration_ms: Column, fwd_packets: Column, bwd_packets: Column) -> dict[str, Column]:
    """A request's flow fields: halves of the totals where a direction is missing, duration in microseconds."""
    half = lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) / 2
    return {
        "flow_duration": F.coalesce(duration_ms.cast("double"), F.lit(1000.0)) * 1000,
        "total_fwd_packets": F.coalesce(fwd_packets.cast("double"), half(packets)),
        "total_bwd_packets": F.coalesce(bwd_packets.cast("double"), half(packets)),
        "total_length_fwd_packets": half(total_bytes),
        "total_length_bwd_packets": half(total_bytes),
    }


def reward(overhead: Column, safety: Column, detected: Column) -> Column:
    return F.when(detected, F.lit(-100.0)).otherwise(safety * 10.0 - overhead)


#: Scalar functions for SQL text; they are inlined by the optimizer.
SQL_FUNCTIONS = {
    "threat_level": "(p DOUBLE) RETURNS STRING RETURN CASE WHEN p < 0.35 THEN 'safe' WHEN p < 0.55 THEN 'low' WHEN p < 0.75 THEN 'medium' WHEN p IS NOT NULL THEN 'critical' END",
    "clip_to": "(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN greatest(low, least(high, x))",
    "safe_ratio": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN coalesce(try_divide(a, b), 0D)",
}


def register_functions(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

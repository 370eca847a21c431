"""Scores from rules, votes and trees, as column expressions.

Weights, thresholds and patterns below are fixed values of the scoring rules.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.functions.stats import clip, ladder, text_entropy

# Patterns of the message rules.
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
DOTTED_QUAD = r"(?<![\p{L}\p{N}_])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}_])"  # word borders of any script
EXECUTION = r"(?i)exec|eval|shell|cmd|powershell|bash|/bin/"
LONG_URL = r"https?://[^\s]{20,}"

CLASSES = ((0.35, "Normal"), (0.55, "Suspicious"), (0.75, "Malicious"))
LEVELS = ((0.35, "safe"), (0.55, "low"), (0.75, "medium"))
ADVICE = (
    (0.35, "Normal traffic. No action required."),
    (0.55, "Elevated risk. Increase monitoring frequency."),
    (0.75, "THREAT DETECTED. Review flow and apply firewall rules."),
)


def classified(p: Column) -> Column:
    return ladder(p, *CLASSES, last="Critical")


def level(p: Column) -> Column:
    return ladder(p, *LEVELS, last="critical")


def advice(p: Column) -> Column:
    return ladder(p, *ADVICE, last="CRITICAL THREAT. Block source immediately and escalate.")


def client_level(p: Column) -> Column:
    return ladder(p, (0.20, "safe"), (0.40, "low"), (0.65, "medium"), last="critical")


def server_advice(p: Column) -> Column:
    return ladder(p, (0.25, "normal"), (0.50, "elevated"), (0.75, "threat"), last="critical")


def message_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds entropy, the six rule flags, score, confidence, attack class and level; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns(
        {
            "entropy": text_entropy(t),
            "has_b64": F.rlike(t, F.lit(BASE64)),
            "has_ip": F.rlike(t, F.lit(DOTTED_QUAD)),
            "has_exec": F.rlike(t, F.lit(EXECUTION)),
            "has_url": F.rlike(t, F.lit(LONG_URL)),
            "n_text": F.length(t),
        }
    )
    weighted = (
        (F.col("entropy") > 4.5, 0.10),
        (F.col("has_b64"), 0.20),
        (F.col("has_ip"), 0.08),
        (F.col("has_exec"), 0.45),
        (F.col("has_url") & (F.col("n_text") > 200), 0.15),
        (F.col("n_text") > 4096, 0.05),
    )
    score = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in weighted), F.lit(0.0))
    rules = [F.col("entropy") > 4.5, F.col("has_b64"), F.col("has_ip"), F.col("has_exec"), F.col("has_url"), F.col("n_text") > 4096]
    fired = sum((r.cast("int") for r in rules), F.lit(0))
    df = df.withColumns({"score": F.round(F.least(score, F.lit(1.0)), 4), "fired": fired})
    s = F.col("score")
    return df.withColumns(
        {
            "confidence": F.round(F.lit(0.90) + F.least(F.col("fired") * 0.015, F.lit(0.09)), 4),
            "attack_class": F.when(s < 0.10, "Benign")
            .when(F.col("has_exec"), "Command Injection")
            .when(F.col("has_b64"), "Data Exfiltration")
            .when(F.col("has_url"), "Phishing / C2")
            .otherwise("Anomalous Activity"),
            "level": level(s),
        }
    )


def soft_vote(scores: Column, digits: int = 4) -> Column:
    """Mean of an array of probabilities, rounded; 0 for none."""
    present = F.filter(F.coalesce(scores, F.array().cast("array<double>")), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(present) > 0, F.round(total / F.size(present), digits)).otherwise(F.lit(0.0))


def weighted_vote(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of predictions weighted by, for instance, each model's F1, over the sum of the weights."""
    total = sum(weights[n] for n in scores)
    return sum((scores[n] * F.lit(weights[n] / total) for n in scores), F.lit(0.0))


def scaled(value: Column, center: float | None, scale: float | None, limit: float = 10.0) -> Column:
    """Clipped (x - center) / scale; 0 for a feature that the scaler doesn't know; a missing value counts as 0 before."""
    if center is None or scale is None:
        return F.lit(0.0)
    return clip((F.coalesce(value, F.lit(0.0)) - center) / (scale or 1.0), -limit, limit)


def vector(row_columns: Sequence[str], names: Sequence[str]) -> Column:
    """Ordered array of features: the column, else log1p of the base of a ``_log`` name, else 0."""

    def one(name: str) -> Column:
        if name in row_columns:
            return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        base = name.removesuffix("_log")
        if base != name and base in row_columns:
            return F.coalesce(F.log1p(F.greatest(F.col(base).cast("double"), F.lit(0.0))), F.lit(0.0))
        return F.lit(0.0)

    return F.array(*[one(n) for n in names])


def traffic_score(packets: Column, total_bytes: Column, duration_ms: Column, size_variation: Column, gap_anomaly: Column, watched_port: Column) -> Column:
    seconds = F.greatest(duration_ms / 1000.0, F.lit(0.001))
    score = (
        F.least(size_variation, F.lit(1.0)) * 0.25
        + F.least(gap_anomaly, F.lit(1.0)) * 0.30
        + watched_port.cast("double") * 0.35
        + (packets / seconds > 500).cast("double") * 0.10
        + F.when(total_bytes / seconds > 1e6, 0.15).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(1.0)), 4)


def multi_signal_score(actions: Column, span_us: Column, rapid: Column, kinds: Column, destinations: Column, total_bytes: Column, connections: Column, device: Column) -> Column:
    """Weighted sum of a constant network part, behaviour, metadata leak and device risk."""
    add = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    busy = (actions >= 2) & (span_us > 0) & (F.try_divide(actions.cast("double"), span_us.cast("double")) * 60_000_000 > 60)
    behaviour = F.least(add(busy, 0.3) + add(rapid > 5, 0.3) + add(kinds > 20, 0.2), F.lit(1.0))
    crowded = (destinations > 0) & (connections > 0) & (F.try_divide(connections.cast("double"), destinations.cast("double")) > 10)
    leak = F.least(add(destinations > 50, 0.3) + add(total_bytes > 100_000_000, 0.3) + add(connections > 100, 0.2) + add(crowded, 0.2), F.lit(1.0))
    return F.lit(0.5 * 0.3) + behaviour * 0.25 + leak * 0.3 + device * 0.15


def signal_confidence(packets: Column, actions: Column, total_bytes: Column, gaps: Column) -> Column:
    less = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return clip(F.lit(1.0) - less(packets < 10, 0.3) - less(actions == 0, 0.2) - less(total_bytes == 0, 0.2) - less(gaps == 0, 0.1), 0.1, 1.0)


@dataclass(frozen=True)
class FlatTree:
    """A tree in arrays: node i tests feature[i] <= threshold[i] and goes left or right; feature -1 marks a leaf."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    leaf: tuple[float, ...]

    def column(self, features: Sequence[Column], node: int = 0) -> Column:
        if self.feature[node] < 0:
            return F.lit(self.leaf[node])
        goes_left = features[self.feature[node]] <= self.threshold[node]
        return F.when(goes_left, self.column(features, self.left[node])).otherwise(self.column(features, self.right[node]))


def forest_score(trees: Sequence[FlatTree], weights: Sequence[float], features: Sequence[Column]) -> Column:
    """Weighted sum of the trees as nested conditions; 0 for no tree."""
    return sum((t.column(features) * F.lit(w) for t, w in zip(trees, weights, strict=True)), F.lit(0.0))


def forest_to_json(trees: Sequence[FlatTree], weights: Sequence[float]) -> str:
    return json.dumps({"weights": list(weights), "trees": [asdict(t) for t in trees]})


def forest_from_json(text: str) -> tuple[list[FlatTree], list[float]]:
    stored = json.loads(text)
    return [FlatTree(**{k: tuple(v) for k, v in t.items()}) for t in stored["trees"]], stored["weights"]

"""Evaluation: confusion matrix and its rates, ranking quality, regression errors, losses, impurities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.functions.stats import clip, ratio, zero
from sentrymill.operators.ordering import running_sum
from sentrymill.sources.tables import bounded_broadcast


def confusion(df: DataFrame, truth: Column, predicted: Column, threshold: float = 0.5) -> DataFrame:
    """One row: tp, tn, fp, fn with both values strictly above the threshold as positive, and the rates (0 for a denominator of 0)."""
    y, p = truth > threshold, predicted > threshold
    c = df.where(truth.isNotNull() & predicted.isNotNull()).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")
    )
    return rates(c)


def rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    c = counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(df: DataFrame, truth: Column, score: Column, key: str) -> DataFrame:
    """One row ``auc``: positives ranked above negatives by (score descending, key); ties in score aren't averaged; 0.5 for a single class."""
    rows = df.where(truth.isNotNull() & score.isNotNull()).select((truth > 0.5).cast("int").alias("y"), score.alias("s"), F.col(key).alias("k"))
    ranked = running_sum(rows, [F.desc("s"), F.col("k")], F.col("y"), "tp")
    sums = ranked.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"), F.sum(F.when(F.col("y") == 0, F.col("tp"))).alias("area"))
    return sums.select(ratio(F.col("area"), F.col("p") * F.col("n"), 0.5).alias("auc"))


def regression(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: mse, mae, r2 (0 where the truth doesn't vary)."""
    e = truth - predicted
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("v")).select(
        "mse", "mae", F.when(F.col("v") == 0, 0.0).otherwise(1 - F.col("mse") / F.col("v")).alias("r2")
    )


def losses(truth: Column, predicted: Column, delta: float = 1.0, eps: float = 1e-15) -> dict[str, Column]:
    """Mean losses as aggregate columns; hinge takes the truth as -1 or 1."""
    e = truth - predicted
    p = clip(predicted, eps, 1 - eps)
    side = F.when(truth > 0.5, 1.0).otherwise(-1.0)
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    return {
        "mse": F.avg(e * e),
        "mae": F.avg(F.abs(e)),
        "binary_cross_entropy": F.avg(-(truth * F.ln(p) + (1 - truth) * F.ln(1 - p))),
        "cross_entropy": F.avg(-truth * F.ln(p)),
        "hinge": F.avg(F.greatest(F.lit(0.0), 1 - side * predicted)),
        "huber": F.avg(huber),
    }


def class_impurity(df: DataFrame, groups: list[str], label: str) -> DataFrame:
    """Gini and entropy (base 2) of the label per group."""
    counted = df.where(F.col(label).isNotNull()).groupBy(*groups, label).agg(F.count("*").alias("c"))
    sums = counted.groupBy(*groups).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum(F.col("c") * F.log2("c")).alias("cl"))
    n = F.col("n")
    return sums.select(*groups, "n", (1 - F.col("sq") / (n * n)).alias("gini"), (F.log2(n) - F.col("cl") / n).alias("entropy"))


def value_impurity(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Variance about the mean, and mean absolute distance from the upper median, per group; without groups of all rows.

    The upper median is the smallest value with more than half of the rows at or below it, taken from
    running counts of the distinct values over all groups, so that no task holds a group.
    """
    g = F.struct(*groups) if groups else F.lit(0)
    rows = df.where(F.col(value).isNotNull()).select(g.alias("g"), F.col(value).cast("double").alias("v"))
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    running = running_sum(counted, [F.col("g"), F.col("v")], F.col("c"), "upto")
    whole = running.groupBy(F.col("g").alias("k")).agg(F.min(F.col("upto") - F.col("c")).alias("before"), F.sum("c").alias("n"))
    same = F.col("g").eqNullSafe(F.col("k"))
    half = F.col("upto") - F.col("before") > F.floor(F.col("n") / 2)
    median = running.join(bounded_broadcast(whole), same).where(half).groupBy("k", "n").agg(F.min("v").alias("median"))
    mae = counted.join(bounded_broadcast(median), same).groupBy("k", "n", "median").agg((F.sum(F.abs(F.col("v") - F.col("median")) * F.col("c")) / F.sum("c")).alias("mae"))
    mse = rows.groupBy("g").agg(F.var_pop("v").alias("mse"))
    return mae.join(mse, same).select(*[F.col(f"g.{c}").alias(c) for c in groups], "n", "median", zero(F.col("mse")).alias("mse"), "mae")


def split_score(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Impurity of a split: each side's (rows, impurity) weighted by its rows."""
    (n, i), (m, j) = left, right
    return ratio(n * i + m * j, n + m)


def majority(df: DataFrame, groups: list[str], label: str) -> DataFrame:
    """The most frequent label per group, the smallest among ties."""
    counted = df.where(F.col(label).isNotNull()).groupBy(*groups, label).agg(F.count("*").alias("c"))
    best = F.max_by(F.col(label), F.struct("c", -F.col(label))).alias("label")
    return counted.groupBy(*groups).agg(best, F.max("c").alias("votes"))

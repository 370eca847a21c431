"""Preparing feature matrices: statistics, imputation, scaling, encoding, selection, sampling, splitting.

Statistics are population ones. Fitting is one aggregation over all columns at once; its single row is
joined back as a broadcast, so fitting and applying stay one lazy plan. Quantiles are fitted when the
operator is called and stand in the plan as literals; they are exact, in bounded memory, unless ``accuracy`` is given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.operators.ordering import global_index, hashed_rank
from sentrymill.sources.tables import bounded_broadcast

TINY = 1e-10
SKETCH = 10_000


def _with(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Every row with the one row of fitted values beside it."""
    return df.join(F.broadcast(fitted))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], accuracy: int | None = None) -> dict[str, list[float | None]]:
    """Interpolated quantiles of the non-null values of each column, exact unless ``accuracy`` is given.

    Exact ones take four aggregations of bounded memory: rows are counted, a sketch brackets each quantile, the rows below a bracket
    are counted, and only values inside it, a few of ten thousand, are counted one by one and ranked. NaN is the greatest value.
    """
    v = {c: F.col(c).cast("double") for c in columns}
    if not columns:
        return {}
    if accuracy is not None:
        row = df.agg(*[F.percentile_approx(v[c], list(shares), accuracy).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(shares) for c in columns}
    counts = df.agg(*[F.count(v[c]).alias(c) for c in columns]).first()
    reach = max(2 / SKETCH, 2 / max(1, min((n for n in counts if n), default=1)))  # the neighbour in rank is inside a bracket as well
    ends = lambda p: (max(0.0, p - reach), min(1.0, p + reach))
    around = sorted({e for p in shares for e in ends(p)})
    sketch = df.agg(*[F.percentile_approx(v[c], around, SKETCH).alias(c) for c in columns]).first()
    brackets = []  # column, share index, low, high, ranks of the two neighbours, weight of the upper one
    for c in columns:
        n = counts[c]
        for i, p in enumerate(shares):
            if n:
                at = (n - 1) * p
                low, high = (sketch[c][around.index(e)] for e in ends(p))
                brackets.append((c, i, low, high, int(at), min(n - 1, int(at) + 1), at - int(at)))
    if not brackets:
        return {c: [None] * len(shares) for c in columns}
    below = df.agg(*[F.count_if(v[c] < low).alias(f"b{k}") for k, (c, _, low, *_) in enumerate(brackets)]).first()
    held = F.array(*[F.when(v[c].between(low, high), F.struct(F.lit(k).alias("k"), v[c].alias("v"))) for k, (c, _, low, high, *_) in enumerate(brackets)])
    inside = df.select(F.explode(F.filter(held, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
    upto = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    spark = df.sparkSession
    ranks = spark.createDataFrame([(k, side, b[at] - below[k]) for k, b in enumerate(brackets) for side, at in (("low", 4), ("high", 5))], "k int, side string, rank bigint")
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    found = {(r.k, r.side): r.v for r in upto.join(F.broadcast(ranks), "k").where(hit).select("k", "side", "v").collect()}  # two values per column and share
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for k, (c, i, *_, weight) in enumerate(brackets):
        a, b = found[(k, "low")], found[(k, "high")]
        out[c][i] = a + (b - a) * weight if weight else a
    return out


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, mean, std, min, max: one row per column, from one aggregation."""
    v = lambda c: F.col(c).cast("double")
    entry = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(v(c)).alias("mean"), F.stddev_pop(v(c)).alias("std"), F.min(v(c)).alias("min"), F.max(v(c)).alias("max")
    )
    return df.agg(F.array(*[entry(c) for c in columns]).alias("cs")).select(F.inline("cs"))


def standard_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std, with std below 1e-10 as 1."""
    fit = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"__s_{c}") < TINY, 1.0).otherwise(F.col(f"__s_{c}"))
    out = _with(df, fit).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / scale(c) for c in columns})
    return out.select(*df.columns)


def minmax_scaled(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Linear to [low, high]; a constant column becomes low."""
    fit = df.agg(*[F.min(F.col(c).cast("double")).alias(f"__a_{c}") for c in columns], *[F.max(F.col(c).cast("double")).alias(f"__b_{c}") for c in columns])
    width = lambda c: F.when(F.col(f"__b_{c}") - F.col(f"__a_{c}") < TINY, 1.0).otherwise(F.col(f"__b_{c}") - F.col(f"__a_{c}"))
    out = _with(df, fit).withColumns({c: (F.col(c) - F.col(f"__a_{c}")) / width(c) * (high - low) + low for c in columns})
    return out.select(*df.columns)


def robust_scaled(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(x - median) / IQR with interpolated quantiles, IQR below 1e-10 as 1; a column without values stays null."""
    fit = quantiles(df, columns, (0.25, 0.5, 0.75), accuracy)

    def scaled(c: str) -> Column:
        low, mid, high = fit[c]
        return F.lit(None).cast("double") if mid is None else (F.col(c) - mid) / (high - low if high - low >= TINY else 1.0)

    return df.withColumns({c: scaled(c) for c in columns}).select(*df.columns)


def winsorized(df: DataFrame, columns: Sequence[str], reach: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """Clipped to [q25 - reach * IQR, q75 + reach * IQR]; nulls stay null."""
    fit = quantiles(df, columns, (0.25, 0.75), accuracy)

    def clipped(c: str) -> Column:
        low, high = fit[c]
        v = F.col(c).cast("double")
        return v if low is None else F.when(v.isNotNull(), F.greatest(F.lit(low - reach * (high - low)), F.least(F.lit(high + reach * (high - low)), v)))

    return df.withColumns({c: clipped(c) for c in columns}).select(*df.columns)


def smallest_mode(df: DataFrame, column: str) -> DataFrame:
    """One row ``mode``: the most frequent non-null value, the smallest among ties."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.agg(F.max("n").alias("m")).join(counted, F.col("n") == F.col("m")).agg(F.min(column).alias("mode"))


def imputed(df: DataFrame, numeric: Sequence[str], text: Sequence[str], unknown: str = "unknown", accuracy: int | None = None) -> DataFrame:
    """Numeric nulls become the median, text nulls the smallest mode, or ``unknown`` where there is none."""
    medians = quantiles(df, numeric, (0.5,), accuracy)
    out = df
    for c in text:
        out = _with(out, smallest_mode(df, c).withColumnRenamed("mode", f"__{c}"))
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double")) for c in numeric} | {c: F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(unknown)) for c in text})
    return out.select(*df.columns)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: classes in sorted order from 0."""
    classes = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return global_index(classes, [F.col("value")], "code").select("value", F.col("code").cast("int").alias("code"))


def first_seen_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, code: classes in the order of their first row."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("o"))
    return global_index(first, [F.col("o"), F.col("value")], "code").select("value", F.col("code").cast("int").alias("code"))


def frequency_codes(df: DataFrame, column: str) -> DataFrame:
    """value, frequency: share among the non-null rows."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("t")))).select("value", (F.col("n") / F.col("t")).alias("frequency"))


def encoded(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Adds the code of each value as ``name``; null for null and unknown values."""
    kind = [c for c in codes.columns if c != "value"][0]
    small = bounded_broadcast(codes.select(F.col("value").alias("__v"), F.col(kind).alias(name)))
    return df.join(small, F.col(column) == F.col("__v"), "left").drop("__v")


def varying(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """column, variance, kept: population variance strictly above the threshold."""
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.var_pop(F.col(c).cast("double")).alias("variance"))
    return df.agg(F.array(*[entry(c) for c in columns]).alias("cs")).select(F.inline("cs")).withColumn("kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def _moments(width: int, pivots: Sequence[float]):
    """Per task one row for each pair of columns: rows with both values, and sums, squares and products of their distances from the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], axis=1) if b.num_rows else np.zeros((0, width))
            held = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float) if b.num_rows else x
            z = np.where(held > 0, x - np.asarray(pivots), 0.0)
            total += np.stack([held.T @ held, z.T @ held, (z * z).T @ held, z.T @ z])
        i, j = np.triu_indices(width)
        columns = [i, j, total[0][i, j], total[1][i, j], total[1][j, i], total[2][i, j], total[2][j, i], total[3][i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    return run


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for each pair of columns i <= j; 0 where a deviation is below 1e-10, null without a row with both values.

    One aggregation takes the means as pivots, then each task sums products of its rows as matrices.
    """
    v = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    means = df.select(*v).agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(len(columns))]).first()
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = df.select(*v).mapInArrow(_moments(len(columns), list(means)), "i bigint, j bigint, " + ", ".join(f"{f} double" for f in fields))
    t = parts.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])
    n = F.col("n")
    dev = lambda s, ss: F.sqrt(F.greatest(F.lit(0.0), F.col(ss) / n - (F.col(s) / n) * (F.col(s) / n)))
    x, y = dev("sx", "sxx"), dev("sy", "syy")
    r = F.when(n > 0, F.when((x < TINY) | (y < TINY), 0.0).otherwise((F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)) / (x * y)))
    names = F.array(*[F.lit(c) for c in columns])
    return t.select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), r.alias("r"))


def uncorrelated(df: DataFrame, columns: Sequence[str], threshold: float) -> list[str]:
    """Greedy from the left: a column is dropped if it correlates above the threshold with one that is kept."""
    r = {(x.a, x.b): x.r for x in correlations(df, columns).collect()}  # one row per pair of columns
    kept: list[str] = []
    for i, c in enumerate(columns):
        if all(abs(r[(k, c)] or 0.0) <= threshold for k in kept if k in columns[:i]):
            kept.append(c)
    return kept


def folds(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Adds fold: contiguous blocks of floor(n / k) rows in order, the last one with the remainder."""
    indexed = global_index(df, order, "__i")
    size = F.greatest(F.floor(F.lit(indexed.count()) / k), F.lit(1))
    return indexed.withColumn("fold", F.least(F.lit(k - 1), F.floor(F.col("__i") / size)).cast("int")).drop("__i")


def train_test(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds is_test: the last floor(n * share) rows in an order shuffled by a hash of the key."""
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    indexed = global_index(df.withColumn("__h", shuffled), [F.col("__h"), F.col(key)], "__i")
    n = indexed.count()
    return indexed.withColumn("is_test", F.col("__i") >= n - int(n * share)).drop("__i", "__h")


def undersampled(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest: the rows with the smallest hashes."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("__least"))
    return hashed_rank(df, [label], key, seed, "__r").join(F.broadcast(least)).where("__r <= __least").select(*df.columns)


def oversampled(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class repeated to the size of the largest: floor or ceiling of the ratio for each row, those first by hash getting one more."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    most = counts.agg(F.max("__n").alias("__most"))
    sized = bounded_broadcast(counts.join(F.broadcast(most)).withColumnRenamed(label, "__l"))
    whole = hashed_rank(df, [label], key, seed, "__r").join(sized, F.col(label).eqNullSafe(F.col("__l")))
    copies = F.floor(F.col("__most") / F.col("__n")) + (F.col("__r") <= F.col("__most") % F.col("__n")).cast("int")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*df.columns, "copy")

"""Aggregate expressions with population statistics and defined results for empty groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def safe_stats(value: Column, name: str) -> dict[str, Column]:
    """mean, std (population), min, max, total of the non-null values; all 0.0 without any."""
    return {
        f"{name}_mean": zero(F.avg(value)),
        f"{name}_std": zero(F.stddev_pop(value)),
        f"{name}_min": zero(F.min(value).cast("double")),
        f"{name}_max": zero(F.max(value).cast("double")),
        f"{name}_total": zero(F.sum(value).cast("double")),
    }


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, ``default`` where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def variation(value: Column) -> Column:
    """Coefficient of variation, 0 for mean 0."""
    return ratio(F.stddev_pop(value), F.avg(value))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def entropy_of(counts: Column) -> Column:
    """Shannon entropy (base 2) of an array of positive counts; 0 for an empty one."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    return F.aggregate(counts, F.lit(0.0), lambda s, n: s - F.when(n > 0, (n / total) * F.log2(n / total)).otherwise(0.0))


_CHARS = 2_000_000


def _row_entropies(texts: list[str]) -> np.ndarray:
    """Entropies of texts by counting the characters of all at once: narrow alphabets in a table, others sorted."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    wide = np.zeros(len(texts), bool)
    wide[row[points >= 128]] = True
    out = np.zeros(len(texts))
    narrow = ~wide[row]
    counts = np.bincount(row[narrow] * 128 + points[narrow], minlength=128 * len(texts)).reshape(-1, 128)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = counts / np.maximum(lengths, 1)[:, None]
        out -= np.where(share > 0, share * np.log2(share), 0.0).sum(axis=1)
    if wide.any():
        key, n = np.unique((row[~narrow] << 21) | points[~narrow], return_counts=True)
        share = n / lengths[key >> 21]
        out[wide] = np.bincount(key >> 21, weights=-share * np.log2(share), minlength=len(texts))[wide]
    return out


@F.pandas_udf(DoubleType())
def _entropies(texts: pd.Series) -> pd.Series:
    plain = texts.fillna("").tolist()
    out, start, held = [np.zeros(0)], 0, 0
    for i, t in enumerate(plain):
        held += len(t)
        if held >= _CHARS or i - start >= 4_096:
            out.append(_row_entropies(plain[start : i + 1]))
            start, held = i + 1, 0
    out.append(_row_entropies(plain[start:]) if start < len(plain) else np.zeros(0))
    return pd.Series(np.concatenate(out))


def text_entropy(text: Column) -> Column:
    """Character entropy of a text, 0 for an empty or null one.

    Counting characters in the JVM takes a lambda call per character or a scan per distinct one; this
    counts the characters of many texts at once, in Arrow batches.
    """
    return F.coalesce(_entropies(text), F.lit(0.0))


def ladder(value: Column, *steps: tuple[float, str], last: str) -> Column:
    """The name of the first bound that the value is below, else ``last``; null for null."""
    out = None
    for bound, name in steps:
        out = F.when(value < bound, F.lit(name)) if out is None else out.when(value < bound, F.lit(name))
    return F.when(value.isNotNull(), out.otherwise(F.lit(last)))

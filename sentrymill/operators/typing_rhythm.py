"""Key strokes from press and release events: dwell and flight times, digraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strokes(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per press with its release: the n-th press of a key goes with the n-th release of it.

    events: keys, ``key``, ``kind`` (down or up), ``at``. Adds dwell (null without release) and flight
    (press minus the release of the press before, null where that has none).
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "key", "kind").orderBy("at", *order))
    numbered = events.withColumn("nth", nth)
    down = numbered.where("kind = 'down'").select(*keys, "key", "nth", F.col("at").alias("pressed"), *order)
    up = numbered.where("kind = 'up'").select(*keys, "key", "nth", F.col("at").alias("released"))
    paired = down.join(up, [*keys, "key", "nth"], "left")
    before = F.lag("released").over(Window.partitionBy(*keys).orderBy("pressed", *order))
    return paired.withColumns({"dwell": F.col("released") - F.col("pressed"), "flight": F.col("pressed") - before})


def digraphs(strokes: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first n times between a release and the next press, 0 where one is missing, padded with 0 to n."""
    w = Window.partitionBy(*keys).orderBy("pressed", *order)
    gap = F.coalesce(F.lead("pressed").over(w) - F.col("released"), F.lit(0))
    first = strokes.withColumns({"gap": gap, "r": F.row_number().over(w), "last": F.lead("pressed").over(w).isNull()}).where((F.col("r") <= n) & ~F.col("last"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("r", "gap"))), lambda x: x["gap"])  # at most n rows a key
    padded = first.groupBy(*keys).agg(values.alias("d"))
    return padded.select(*keys, F.concat("d", F.array_repeat(F.lit(0).cast("bigint"), F.lit(n) - F.size("d"))).alias("digraphs"))

"""Global row numbers and running sums without a single-task window.

Rows are range-partitioned and sorted, which is written to the shared folder so that both passes see
the same partitions; only one number per partition (a count or a sum) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.sources.tables import checkpointed


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    return checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))


def _offsets(per_partition: list, value: str) -> Column:
    total, out = 0, []
    for r in sorted(per_partition, key=lambda r: r["__p"]):
        out += [F.lit(r["__p"]), F.lit(total)]
        total += r[value]
    return F.create_map(*out) if out else F.create_map(F.lit(0), F.lit(0))


def global_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Adds the 0-based position of each row in the given total order, as bigint."""
    s = _sorted(df, order)
    part, pos = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = s.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).collect()  # one row per partition
    return s.withColumn(name, (pos + _offsets(counts, "n")[part]).cast("bigint")).drop("__at")


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of an integer value over all rows up to this one in the given total order."""
    s = _sorted(df.withColumn("__v", value.cast("bigint")), order).withColumn("__p", F.shiftright("__at", 33).cast("int"))
    sums = s.groupBy("__p").agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("n")).collect()  # one row per partition
    inside = F.sum("__v").over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn(name, (inside + _offsets(sums, "n")[F.col("__p")]).cast("bigint")).drop("__at", "__p", "__v")


def hashed_rank(df: DataFrame, groups: list[str], key: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row of its group in an order shuffled by a hash of the key.

    Two levels: rows are counted per group and bucket of the hash (4096 buckets), and ranked only inside
    their bucket, so that a group with a third of all rows is spread over the tasks.
    """
    placed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).withColumn("__b", F.substring("__h", 1, 3))
    earlier = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    offsets = counted.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__h", key)))
    same = F.col("__b") == F.col("__ob")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return ranked.join(offsets, same).withColumn(name, F.col("__r") + F.col("__before")).select(*df.columns, name)

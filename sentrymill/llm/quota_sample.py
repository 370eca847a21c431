"""A sample that matches target category proportions.

Categories are counted (one aggregation with partial counts), integer quotas are allotted on the
driver over the bounded target table, and the rows with the smallest random keys of each category
are taken. The quota-th smallest key is found without sorting a category: keys are counted per
category and key bucket, the bucket in which the quota is reached is looked up, lower buckets are
taken whole, and only the rows of that one bucket, a 4096th of the category, are ranked.

Quotas: every cell gets at least its minimum and at most what is there; the size left is spread in
proportion to the shares over the cells that are at neither bound, and whole rows are given by
largest remainder (ties by cell name). ``report`` has the need of each cell, the larger of its
minimum and its share of the sample rounded half up, and the shortfall where it can't be met.

Defined results: several source ids may have one name, and are one source then; of two target rows for one
cell the first in order stands; rows whose source or category is null or not among the targets are in no cell and
never sampled, but count for the sample's size; cells without rows have availability 0; null shares
and minimums are 0; ties of random keys are broken by the row id; an empty table has size 0 and
every minimum as shortfall; further columns are carried along by ``sample``.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.sources.tables import small_rows

CELL_BOUND = 10_000
BUCKETS = 4_096
REPORT_SCHEMA = "source string, category int, target_share double, min_rows bigint, need bigint, available bigint, quota bigint, shortfall bigint"


def need(share: float | None, minimum: int | None, size: int) -> int:
    """The larger of the minimum and share * size rounded half up, in decimal arithmetic."""
    wanted = (Decimal(str(share or 0.0)) * size).quantize(Decimal(1), ROUND_HALF_UP)
    return max(int(minimum or 0), int(wanted))


def quotas(shares: list[float], minimums: list[int], available: list[int], size: int) -> list[int]:
    """Integer quotas between min(minimum, available) and available that sum to ``size`` where the bounds allow it."""
    low = [min(a, b) for a, b in zip(minimums, available, strict=True)]
    exact = [Fraction(str(s)) for s in shares]
    fixed: dict[int, int] = {}
    while True:
        free = [i for i in range(len(shares)) if i not in fixed]
        left = size - sum(fixed.values())
        weight = sum(exact[i] for i in free)
        ideal = {i: exact[i] / weight * left if weight and left > 0 else Fraction(0) for i in free}
        under = {i: low[i] for i in free if ideal[i] < low[i]}
        over = {i: available[i] for i in free if ideal[i] > available[i]}
        lacking, excess = sum(low[i] - ideal[i] for i in under), sum(ideal[i] - available[i] for i in over)
        moved = under if under and lacking >= excess else over
        if not moved:
            break
        fixed |= moved
    out = fixed | {i: int(ideal[i]) for i in free}
    short = min(size - sum(out.values()), sum(available[i] - out[i] for i in free)) if free else 0
    for i in sorted(free, key=lambda i: (-(ideal[i] - out[i]), i)):
        if short > 0 and exact[i] > 0 and out[i] < available[i]:
            out[i] += 1
            short -= 1
    return [out[i] for i in range(len(shares))]


class QuotaSample:
    """``rows`` has source_id and category columns; ``names`` maps source ids to the names used in ``targets``."""

    def __init__(
        self,
        rows: DataFrame,
        names: DataFrame,
        targets: DataFrame,
        row_id: str = "record_id",
        source_id: str = "dataset_id",
        source: str = "dataset_name",
        category: str = "label_family",
        share: str = "target_share",
        minimum: str = "min_rows",
        one_in: int = 10,
        seed: int = 42,
    ):
        self.rows, self.row_id, self.source_id, self.category, self.seed = rows, row_id, source_id, category, seed
        self.source = source
        self.by_id = {r[0]: r[1] for r in small_rows(names.select(source_id, source).where(F.col(source_id).isNotNull()), CELL_BOUND)}
        listed = sorted(
            ((r[0], r[1], r[2] or 0.0, int(r[3] or 0)) for r in small_rows(targets.select(source, category, share, minimum), CELL_BOUND)),
            key=lambda r: (r[0] or "", -1 if r[1] is None else r[1]),
        )
        self.targets = list({(t[0], t[1]): t for t in reversed(listed)}.values())[::-1]  # each cell once
        self.one_in = one_in
        self._cells: list[tuple] | None = None

    def cells(self) -> list[tuple]:
        """(source, category, share, minimum, need, available, quota, shortfall) of every target row, on the driver."""
        if self._cells is None:
            ids = list(self.by_id)
            cell = F.when(F.col(self.source_id).isin(ids), F.col(self.source_id))
            counted = small_rows(self.rows.groupBy(cell.alias("s"), F.col(self.category).alias("c")).count(), CELL_BOUND * 10)
            size = sum(r["count"] for r in counted) // self.one_in
            there: dict[tuple, int] = {}
            for r in counted:
                if r.s is not None and r.c is not None:
                    key = (self.by_id[r.s], r.c)
                    there[key] = there.get(key, 0) + r["count"]
            available = [there.get((s, c), 0) for s, c, _, _ in self.targets]
            allotted = quotas([t[2] for t in self.targets], [t[3] for t in self.targets], available, size)
            self._cells = [
                (s, c, share, minimum, n := need(share, minimum, size), a, q, max(0, n - a))
                for (s, c, share, minimum), a, q in zip(self.targets, available, allotted, strict=True)
            ]
        return self._cells

    def report(self) -> DataFrame:
        frame = self.rows.sparkSession.createDataFrame(self.cells(), REPORT_SCHEMA)
        return frame.withColumnsRenamed({"source": self.source, "category": self.category})

    def unmet(self) -> DataFrame:
        """(source, category) of the target rows whose need exceeds what is there."""
        return self.report().where("shortfall > 0").select(self.source, self.category)

    def sample(self) -> DataFrame:
        """The rows sampled, with all their columns."""
        spark = self.rows.sparkSession
        wanted = [(s, c, q) for s, c, _, _, _, _, q, _ in self.cells() if q > 0]
        quota = F.broadcast(spark.createDataFrame(wanted, "s string, c int, quota bigint"))  # one row per target at most
        kind = self.rows.schema[self.source_id].dataType.simpleString()
        names = F.broadcast(spark.createDataFrame(list(self.by_id.items()), f"i {kind}, s string"))  # CELL_BOUND rows at most
        keyed = self.rows.select(
            F.struct("*").alias("row"),
            F.col(self.source_id).alias("i"),
            F.col(self.category).cast("int").alias("c"),
            F.col(self.row_id).alias("id"),
            F.md5(F.concat_ws(":", F.lit(self.seed), F.col(self.row_id).cast("string"))).alias("key"),
        ).join(names, "i").join(quota, ["s", "c"]).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
        upto = Window.partitionBy("s", "c").orderBy("bucket")
        counted = keyed.groupBy("s", "c", "bucket").agg(F.count("*").alias("n"), F.max("quota").alias("quota"))
        reached = counted.withColumn("upto", F.sum("n").over(upto)).where("upto - n < quota")
        edge = reached.groupBy("s", "c").agg(F.max("bucket").alias("edge"), F.max_by(F.col("quota") - (F.col("upto") - F.col("n")), "bucket").alias("rest"))
        placed = keyed.join(F.broadcast(edge), ["s", "c"])  # one row per target at most
        ranked = F.row_number().over(Window.partitionBy("s", "c", "bucket").orderBy("key", "id"))
        whole = placed.where(F.col("bucket") < F.col("edge")).select("row")
        last = placed.where(F.col("bucket") == F.col("edge")).withColumn("rank", ranked).where("rank <= rest").select("row")
        return whole.unionByName(last).select("row.*")

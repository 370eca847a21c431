"""Nearest neighbours of a query set among all rows, exact by cells and bounds or quicker by the nearest cells only, and the samplers built on them.

Rows are put into cells around at most ``CELLS`` centres, which are fitted on at most ``FITTED`` rows; every row is
in the index. A cell is cut into blocks of about ``size`` rows, so that a crowded one is spread. Each query first
searches the blocks of its ``PROBES`` nearest cells, one matrix product for a block of queries and one of rows,
which bounds the distance of its k-th neighbour. The exact search then takes those other cells whose centre is not
farther than that bound and the cell's radius: no row outside them can be among the k nearest. The driver holds
centres, radii and sizes of cells; queries and rows are never paired across cells that the bound excludes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.functions.vectors import between
from sentrymill.operators.ordering import global_index
from sentrymill.sources.tables import checkpointed, small_rows


CELLS, FITTED, ROUNDS, PROBES = 256, 20_000, 8, 4


class Cells:
    """Centres, and the radius and number of rows of each cell; cell -1 holds vectors without a direction, for cosine."""

    def __init__(self, rows: DataFrame, key: str, vector: str, metric: str):
        self.metric = metric
        sample = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(FITTED).collect()  # a bounded sample
        x = self.placed(np.array([r.v for r in sample], float)) if sample else np.zeros((0, 1))
        k = max(1, min(CELLS, int(len(x) ** 0.5)))
        self.centres = x[np.linspace(0, max(0, len(x) - 1), k).astype(int)] if len(x) else np.zeros((1, 1))
        for _ in range(ROUNDS if len(x) else 0):
            own = self.away(x).argmin(axis=1)
            for c in range(len(self.centres)):
                if (own == c).any():
                    self.centres[c] = x[own == c].mean(axis=0)
        self.radius: dict[int, float] = {}
        self.count: dict[int, int] = {}

    def placed(self, v: np.ndarray) -> np.ndarray:
        """Vectors as distances are taken between them: for cosine those of length 1."""
        if self.metric != "cosine":
            return v
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.where(norm < 1e-10, 0.0, v / np.maximum(norm, 1e-300))

    def away(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1)[None, :]))

    def no_direction(self, v: np.ndarray) -> np.ndarray:
        return (np.linalg.norm(v, axis=1) < 1e-10) if self.metric == "cosine" else np.zeros(len(v), bool)


def _vectors(b: pa.RecordBatch, i: int) -> np.ndarray:
    flat = b.column(i).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 1)


def _assigned(rows: DataFrame, key: str, vector: str, cells: Cells) -> DataFrame:
    """id, v, cell, off: every row with the nearest centre and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, v = shared.value, _vectors(b, 1)
                away = own.away(own.placed(v))
                cell = away.argmin(axis=1)
                off = away[np.arange(len(v)), cell]
                none = own.no_direction(v)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(none, -1, cell).astype(np.int32)), pa.array(np.where(none, 0.0, off))], names=["id", "v", "cell", "off"])

    picked = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "id bigint, v array<double>, cell int, off double")


def _gathered(placed: DataFrame, size: int, counts: dict[int, int], side: str) -> DataFrame:
    """cell and one row per block of it: ids and vectors one after the other."""
    pieces = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-n // size)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    block = F.pmod(F.xxhash64("id"), F.coalesce(F.element_at(pieces, F.col("cell")), F.lit(1)))
    extra = [c for c in placed.columns if c not in ("id", "v", "cell", "off")]
    g = placed.groupBy("cell", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "v", *extra))).alias("rs"))  # about ``size`` rows
    return g.select("cell", F.col("rs.id").alias(f"{side}_ids"), F.flatten("rs.v").alias(f"{side}_flat"))


def _best(k: int | None, metric: str, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                qi, di = np.array(row["q_ids"], np.int64), np.array(row["d_ids"], np.int64)
                q, d = np.array(row["q_flat"]).reshape(len(qi), -1), np.array(row["d_flat"]).reshape(len(di), -1)
                if metric == "cosine":
                    nq, nd = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
                    away = -(q @ d.T) / np.maximum(np.outer(nq, nd), 1e-300)
                    away[nq < 1e-10, :] = 0
                    away[:, nd < 1e-10] = 0
                else:
                    away = np.stack([np.sqrt(((d - x) ** 2).sum(axis=1)) for x in q])
                if skip_self:
                    away[qi[:, None] == di[None, :]] = np.inf
                if k is None:
                    order = np.broadcast_to(np.arange(len(di)), away.shape)
                else:
                    order = np.lexsort((np.broadcast_to(di, away.shape), away), axis=1)[:, :k]
                value = np.take_along_axis(away, order, axis=1)
                keep = np.isfinite(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qi, keep.sum(axis=1))), pa.array(di[order][keep]), pa.array(value[keep])], names=["query", "neighbour", "away"]
                )

    return run


def _probed(queries: DataFrame, key: str, vector: str, cells: Cells, probes: int, bounds: DataFrame | None) -> DataFrame:
    """id, v, cell: each query with its nearest cells; or, given (query, bound), with all other cells that the bound leaves."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    picked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    picked = picked.withColumn("bound", F.lit(None).cast("double")) if bounds is None else picked.join(bounds, picked.id == bounds["query"], "left").select("id", "v", "bound")

    bounded = bounds is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        numbers = np.array(sorted(c for c in own.count if c >= 0), int)
        for b in batches:
            if not b.num_rows:
                continue
            v = _vectors(b, 1)
            away = own.away(own.placed(v))[:, numbers]
            near = np.argsort(away, axis=1, kind="stable")[:, :probes]
            mask = np.zeros(away.shape, bool)
            if near.size:
                np.put_along_axis(mask, near, True, axis=1)
            if bounded:
                bound = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                radius = np.array([own.radius[c] for c in numbers])
                # A small allowance for rounding; queries without k neighbours so far, or without direction, search everything.
                everything = np.isnan(bound) | own.no_direction(v)
                mask = ~mask & ((away - radius[None, :] <= (bound * (1 + 1e-9) + 1e-9)[:, None]) | everything[:, None])
            row, at = np.nonzero(mask)
            cell = numbers[at] if len(numbers) else np.zeros(0, int)
            if -1 in own.count and not bounded:
                row, cell = np.concatenate([row, np.arange(len(v))]), np.concatenate([cell, np.full(len(v), -1)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return picked.mapInArrow(run, "id bigint, v array<double>, cell int")


class Neighbours:
    """All rows in cells and blocks, for searches with several query sets."""

    def __init__(self, rows: DataFrame, key: str, vector: str, metric: str = "euclidean", size: int = 1_024):
        self.key, self.vector, self.metric, self.size = key, vector, metric, size
        self.cells = Cells(rows, key, vector, metric)
        assigned = checkpointed(_assigned(rows, key, vector, self.cells))
        for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect():  # one row per cell
            self.cells.count[r.cell], self.cells.radius[r.cell] = r.n, r.radius
        self.blocks = checkpointed(_gathered(assigned, size, self.cells.count, "d"))

    def _found(self, queries: DataFrame, k: int | None, probes: int, skip_self: bool, bounds: DataFrame | None) -> DataFrame:
        probed = checkpointed(_probed(queries, self.key, self.vector, self.cells, probes, bounds))
        counts = {r.cell: r["count"] for r in probed.groupBy("cell").count().collect()}  # one row per cell
        return _gathered(probed, self.size, counts, "q").join(self.blocks, "cell").drop("cell").mapInArrow(_best(k, self.metric, skip_self), "query bigint, neighbour bigint, away double")

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("away", "neighbour"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = True, exact: bool = True, probes: int = PROBES) -> DataFrame:
        """(query, neighbour, distance or similarity, rank): the k nearest of each query; the smaller id first on ties."""
        best = self._ranked(self._found(queries, k, probes, skip_self, None), k)
        if exact:
            best = checkpointed(best)
            kth = F.max(F.when(F.col("rank") == k, F.col("away")))
            # Vectors of length 1 with cosine c are sqrt(2 - 2c) apart.
            bound = F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * kth)) if self.metric == "cosine" else kth
            rest = self._found(queries, k, probes, skip_self, best.groupBy("query").agg(bound.alias("bound")))
            best = self._ranked(best.drop("rank").unionByName(rest), k)
        value = (-F.col("away")).alias("similarity") if self.metric == "cosine" else F.col("away").alias("distance")
        return best.select("query", "neighbour", value, "rank")

    def distances(self, queries: DataFrame, skip_self: bool = False) -> DataFrame:
        """(query, neighbour, distance) of every query to every row: as many rows as that is, and no ranking."""
        return self._found(queries, None, len(self.cells.centres), skip_self, None).select("query", "neighbour", F.col("away").alias("distance"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean", skip_self: bool = True, size: int = 1_024, exact: bool = True) -> DataFrame:
    return Neighbours(rows, key, vector, metric, size).nearest(queries, k, skip_self, exact)


def smote(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows (base, neighbour, n, vector) that fill the smaller of two classes up to the larger.

    The n-th synthetic row takes its base and neighbour in turn and its place between them from a hash,
    so that results are the same in every run. One minority row has no neighbour and raises.
    """
    counts = sorted(((r["count"], r[label]) for r in small_rows(df.where(F.col(label).isNotNull()).groupBy(label).count())), key=lambda x: (x[0], x[1]))
    if len(counts) != 2:
        raise ValueError("two classes are needed")
    (few, minority), (many, _) = counts
    if few < 2:
        raise ValueError("one minority row has no neighbour")
    rows = df.where(F.col(label) == minority)
    found = nearest(rows, rows, key, vector, min(k, few - 1))
    missing = many - few
    numbered = global_index(rows.select(key, vector), [F.col(key)], "__i")
    times = F.floor(F.lit(missing) / few) + (F.col("__i") < missing % few).cast("int")
    wanted = numbered.where(times > 0).select(F.col(key).alias("base"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("n"))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col("base").cast("string"), F.col("n").cast("string")))
    digits = lambda at, n: F.conv(F.substring(drawn, at, n), 16, 10).cast("bigint")
    pick = (digits(1, 8) % min(k, few - 1) + 1).alias("pick")
    share = digits(9, 12).cast("double") / float(1 << 48)
    chosen = wanted.select("base", "v", "n", pick, share.alias("share")).join(
        found.select(F.col("query").alias("base"), "neighbour", F.col("rank").alias("pick")), ["base", "pick"]
    )
    other = rows.select(F.col(key).alias("neighbour"), F.col(vector).alias("w"))
    return chosen.join(other, "neighbour").select("base", "neighbour", "n", between(F.col("v"), F.col("w"), F.col("share")).alias("vector"))

"""Same or near-same records across splits, by winnowing fingerprints.

A record is a sequence of measurements. Two records overlap if enough of their measurements agree:
both null, or within a relative tolerance of the larger absolute value. With 16 measurements of
which at most three may differ, a pair that overlaps agrees, on the sequence closed to a ring, in a
run of at least ``ceil(13 / 3) = 5`` neighbouring measurements. Winnowing with grams of ``GRAM`` = 4
tokens and a window of 2 grams selects, for any run of 5 tokens, the smaller of two rolling hashes
from those tokens alone, so both records select the same gram: no overlapping pair is missed.

Tolerance: a token is the cell of a measurement on a logarithmic grid (with its sign; null and zero
have their own). The searched split uses the cell of each value; the other one takes, for every
window, all combinations of the one or two cells that an agreeing value can lie in, and selects the
minimum of each. A value within tolerance is in one of these cells, hence the guarantee holds for it
as well. A hash's top bit marks grams with several nulls or zeros, so that they are selected last.

Stages: selected minima of both sides are joined to seeds. Each fingerprint carries its record's sketch,
four bits a measurement, and a seed whose sketches rule out that enough measurements agree goes no
further; values that agree never differ in it, so nothing is lost, while nearly all chance seeds end
here. The seeds of a pair are collinear if they lie at the same positions on both sides, which the
position in the hash sees to; they are chained to the runs of measurements that they cover. Each chain
is extended by aligning the whole records, in the JVM, on every measurement. Tasks exchange 24 bytes
per fingerprint; records move for the alignment only if there are more pairs than ``PAIR_BOUND``, else
the pairs are broadcast. Nothing is collected, and no seed is capped. Rows that agree with a third of
all others give as many result rows, since the result lists pairs.

Defined results: NaN and infinite measurements agree with nothing; 0.0 and -0.0 agree; rows with a
null id or a split that is neither side take no part; exact repeats are pairs like any other; an
empty side gives no pairs; further columns don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.sources.tables import checkpointed, spread

#: The order puts measurements with many values between those with few, and apart those that are zero or null together, so that any four in a row are selective.
MEASUREMENTS = (
    "flow_iat_mean", "fwd_packets", "bwd_bytes", "duration", "bwd_pkt_len_max", "fwd_iat_mean", "fwd_pkt_len_std", "init_fwd_win_bytes",
    "flow_iat_std", "fwd_bytes", "bwd_packets", "bwd_iat_mean", "active_mean", "fwd_pkt_len_max", "flow_iat_max", "bwd_pkt_len_std",
)
LEAST_AGREEING = 13
TOLERANCE = 0.01
GRAM = 4
CELL = 0.1
PAIR_BOUND = 50_000
#: Measurements that a sketch has room for; of further ones it says nothing.
SKETCHED = 16
_LOWEST = 0x1111111111111111
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 2_048


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tokens(values: np.ndarray, nulls: np.ndarray, ids: np.ndarray, slack: float, cell_width: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the value shrunk and grown by ``slack``, as unsigned integers with the kind in the low bits."""
    size = np.abs(values)
    plain = ~nulls & np.isfinite(values) & (size > 0)
    log = np.log(np.where(plain, size, 1.0))
    out = []
    for shift in (-slack, slack):
        cell = np.floor((log + shift) / cell_width).astype(np.int64) * 8 + np.where(values < 0, 1, 0)
        cell = np.where(plain, cell, np.where(nulls, 2, np.where(values == 0, 3, ids * 8 + 4)))
        out.append(cell.astype(np.int64).view(np.uint64))
    return out[0], out[1]


def _rolling(tokens: list[np.ndarray]) -> np.ndarray:
    h = np.zeros_like(tokens[0])
    for t in tokens:
        h = h * _BASE + (t + np.uint64(0x632BE59BD9B4E019))
    return h


def _poor(tokens: list[np.ndarray]) -> np.ndarray:
    """Whether at least two tokens of a gram are null or zero."""
    return sum(((t == 2) | (t == 3)).astype(np.int8) for t in tokens) >= 2


def _gram(tokens: list[np.ndarray], position: int) -> np.ndarray:
    """The hash of a gram; its top bit marks a poor one, its lowest four bits are its position."""
    h = _mixed(_rolling(tokens) + np.uint64(position + 1) * np.uint64(0xD6E8FEB86659FD93))
    return (h >> np.uint64(5) << np.uint64(4)) | np.uint64(position % 16) | (_poor(tokens).astype(np.uint64) << np.uint64(63))


def _sketch(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per row 16 times three bits of the lower cell and one whether the value can also lie in the next cell, whose bits are one more."""
    out = np.zeros(len(low), dtype=np.uint64)
    for j in range(min(SKETCHED, low.shape[1])):
        bits = ((low[:, j] >> np.uint64(3)) + np.uint64(3) * (low[:, j] & np.uint64(7))) & np.uint64(7)
        out |= (bits | ((low[:, j] != high[:, j]).astype(np.uint64) << np.uint64(3))) << np.uint64(4 * j)
    return out


def _ruled_out(searched: Column, held_out: Column) -> Column:
    """In how many measurements two sketches can't agree."""
    lowest = F.lit(_LOWEST)
    bit = lambda c, n: F.shiftrightunsigned(c, n).bitwiseAND(lowest) if n else c.bitwiseAND(lowest)
    t, h, unsure = [bit(searched, n) for n in range(3)], [bit(held_out, n) for n in range(3)], bit(held_out, 3)
    here = t[0].bitwiseXOR(h[0]).bitwiseOR(t[1].bitwiseXOR(h[1])).bitwiseOR(t[2].bitwiseXOR(h[2]))
    carry = h[0].bitwiseAND(h[1])
    there = t[0].bitwiseXOR(h[0]).bitwiseXOR(lowest).bitwiseOR(t[1].bitwiseXOR(h[1]).bitwiseXOR(h[0])).bitwiseOR(t[2].bitwiseXOR(h[2]).bitwiseXOR(carry))
    return F.bit_count(here.bitwiseAND(there.bitwiseOR(unsure.bitwiseXOR(lowest))))


def exact_fingerprints(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) selected by winnowing; tokens has a row per record."""
    n, m = tokens.shape
    cols = [tokens[:, j] for j in range(m)]
    grams = np.stack([_gram([cols[(i + j) % m] for j in range(GRAM)], i) for i in range(m)], axis=1)
    chosen = np.sort(np.minimum(grams, np.roll(grams, -1, axis=1)), axis=1)
    fresh = np.ones((n, m), dtype=bool)
    fresh[:, 1:] = chosen[:, 1:] != chosen[:, :-1]
    row = np.nonzero(fresh)[0]
    return row, chosen[fresh]


def probing_fingerprints(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) selected over all combinations of the two cells of each token."""
    n, m = low.shape
    cells = [(low[:, j], high[:, j]) for j in range(m)]
    unsure = [low[:, j] != high[:, j] for j in range(m)]
    grams = [
        [_gram([cells[(i + j) % m][c >> j & 1] for j in range(GRAM)], i) for c in range(1 << GRAM)]
        for i in range(m)
    ]
    rows, values = [], []
    everyone = np.ones(n, dtype=bool)
    for i in range(m):
        following = (i + 1) % m
        for c in range(1 << (GRAM + 1)):
            valid = everyone
            for j in range(GRAM + 1):
                if c >> j & 1:
                    valid = valid & unsure[(i + j) % m]
            at = np.nonzero(valid)[0]
            if len(at):
                rows.append(at)
                values.append(np.minimum(grams[i][c & ((1 << GRAM) - 1)][at], grams[following][c >> 1][at]))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _fingerprinter(columns: list[str], tolerance: float, cell_width: float, probing: bool):
    slack = -math.log1p(-tolerance) * 1.0001
    if cell_width <= 2 * slack:
        raise ValueError("cells must be wider than twice the tolerance, so that a value can lie in two at most")
    slack = slack if probing else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                b = whole.slice(start, _ROWS)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                low, high = np.empty((2, len(ids), len(columns)), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(len(columns)):
                        column = b.column(j + 1)
                        nulls = column.is_null().to_numpy(zero_copy_only=False)
                        values = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                        low[:, j], high[:, j] = _tokens(values, nulls, ids, slack, cell_width)
                    row, value = probing_fingerprints(low, high) if probing else exact_fingerprints(low)
                    sketch = _sketch(low, high)
                out = [value.view(np.int64), ids[row], sketch[row].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["gram", "id", "sketch"])

    return run


def fingerprints(records: DataFrame, record_id: str, columns: list[str], tolerance: float, cell_width: float, probing: bool) -> DataFrame:
    """(gram, id, sketch) of every record; ``probing`` selects over all cells that an agreeing value can lie in."""
    plain = records.select(F.col(record_id).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns])
    return spread(plain).mapInArrow(_fingerprinter(columns, tolerance, cell_width, probing), "gram bigint, id bigint, sketch bigint")


def agreeing(left: list[Column], right: list[Column], tolerance: float) -> Column:
    """How many of the paired values agree."""
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        gap = F.abs(a - b)
        near = (gap <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))) & (gap < F.lit(math.inf))
        total = total + F.when(a.isNull() & b.isNull(), 1).when(near, 1).otherwise(0)
    return total


def _covered(starts: Column, m: int) -> Column:
    """The measurements, as bits, in the grams that begin at ``starts`` on a ring of ``m``."""
    out = starts
    for j in range(1, GRAM):
        out = out.bitwiseOR(F.shiftleft(starts, j)).bitwiseOR(F.shiftrightunsigned(starts, m - j))
    return out.bitwiseAND((1 << m) - 1)


def overlaps(
    records: DataFrame,
    record_id: str = "record_id",
    split: str = "split",
    searched: tuple[str, ...] = ("train",),
    held_out: tuple[str, ...] = ("valid", "test"),
    columns: tuple[str, ...] = MEASUREMENTS,
    least: int = LEAST_AGREEING,
    tolerance: float = TOLERANCE,
    cell_width: float = CELL,
) -> DataFrame:
    """(searched_id, held_out_id, seeds, chained, agreeing) of every overlapping pair: selected grams in common,
    measurements that the chains of them cover, and measurements that agree.

    ``least`` may be lower than 13 of 16 only as far as the ring argument holds, see the module. Narrower
    cells make seeds more selective and probe more combinations: a quarter of the width divides the
    chance seeds by 256 and multiplies the held-out side's fingerprints by about 6. Neither changes the result.
    """
    m, names = len(columns), list(columns)
    if m - least > 0 and math.ceil(least / (m - least)) < GRAM + 1:
        raise ValueError("with so few agreeing measurements a pair need not share a run of five")
    rows = records.where(F.col(record_id).isNotNull())
    there, here = rows.where(F.col(split).isin(*searched)), rows.where(F.col(split).isin(*held_out))
    left = fingerprints(there, record_id, names, tolerance, cell_width, False).withColumnsRenamed({"id": "searched_id", "sketch": "searched_sketch"})
    right = fingerprints(here, record_id, names, tolerance, cell_width, True).withColumnsRenamed({"id": "held_out_id", "sketch": "held_out_sketch"})
    seeds = left.join(right, "gram").where(_ruled_out(F.col("searched_sketch"), F.col("held_out_sketch")) <= m - least)
    start = F.expr("shiftleft(1L, CAST(gram & 15 AS INT))")
    chains = checkpointed(seeds.groupBy("searched_id", "held_out_id").agg(F.bit_or(start).alias("starts")))
    few = chains.limit(PAIR_BOUND + 1).count() <= PAIR_BOUND
    chains = chains.select("searched_id", "held_out_id", F.bit_count("starts").alias("seeds"), F.bit_count(_covered(F.col("starts"), m)).alias("chained"))

    def beside(pairs_: DataFrame, side: DataFrame, key: str) -> DataFrame:
        """Pairs with the values of one side; there are as many as chains, if ids are unique."""
        return side.join(F.broadcast(pairs_) if few else pairs_, key)

    def values(side: DataFrame, mark: str, key: str) -> DataFrame:
        return side.select(F.col(record_id).alias(key), *[F.col(c).cast("double").alias(f"{mark}{j}") for j, c in enumerate(names)])

    aligned = beside(beside(chains, values(there, "a", "searched_id"), "searched_id"), values(here, "b", "held_out_id"), "held_out_id")
    score = agreeing([F.col(f"a{j}") for j in range(m)], [F.col(f"b{j}") for j in range(m)], tolerance)
    return aligned.select("searched_id", "held_out_id", "seeds", "chained", score.alias("agreeing")).where(F.col("agreeing") >= least)


def pairs(found: DataFrame) -> DataFrame:
    """(record_a, record_b), the smaller id first."""
    return found.select(
        F.least("searched_id", "held_out_id").alias("record_a"), F.greatest("searched_id", "held_out_id").alias("record_b")
    )


def report(records: DataFrame, found: DataFrame, source: str, record_id: str = "record_id", split: str = "split", held_out: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """Per split and source: records, overlapping records, partners and mean best coverage of a record."""
    best = found.groupBy(F.col("held_out_id").alias(record_id)).agg(
        F.count("*").alias("partners"), (F.max("agreeing") / F.lit(len(MEASUREMENTS))).alias("coverage")
    )
    own = records.where(F.col(split).isin(*held_out)).select(record_id, split, source)
    return (
        own.join(best, record_id, "left")
        .groupBy(split, source)
        .agg(
            F.count("*").alias("records"),
            F.count("coverage").alias("overlapping"),
            F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"),
            F.round(F.avg("coverage"), 6).alias("mean_coverage"),
        )
    )


def coverage(records: DataFrame, found: DataFrame, source: str, record_id: str = "record_id", split: str = "split") -> DataFrame:
    """Per overlapping held-out record and source of its partners: how many partners, and the largest share of measurements that agree with one."""
    own = records.select(F.col(record_id).alias("held_out_id"), F.col(split).alias("split"), F.col(source).alias("source"))
    theirs = records.select(F.col(record_id).alias("searched_id"), F.col(source).alias("train_source"))
    best = found.join(theirs, "searched_id").groupBy("held_out_id", "train_source").agg(
        F.count("*").alias("partners"), F.round(F.max("agreeing") / F.lit(len(MEASUREMENTS)), 6).alias("coverage")
    )
    return best.join(own, "held_out_id").select(F.col("held_out_id").alias(record_id), "split", "source", "train_source", "partners", "coverage")

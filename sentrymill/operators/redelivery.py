"""Messages delivered more than once: keep exactly one delivery of each identifier.

Identifiers of the form ``<producer><separator><number>`` are producer-sequence identifiers. What
has been accepted of a producer is held as disjoint ranges of numbers, so that the state of a
well-behaved producer is one row however many messages it sent. Deliveries are read in the order in
which they are to be preferred: a number inside a range is a repeat; an uncovered number is accepted
once and its range is merged with its neighbours. All other identifiers, those in the form of a UUID
among them, are malformed for this purpose and are resolved by an exact keyed lookup: the first of an
identifier by a partial minimum before the shuffle, and an anti-join with the identifiers seen before.

Sequence identifiers are accepted in two passes of the same fold. The first runs in each map task over
the rows at hand, so that an identifier with a third of all rows costs one row per task. The second runs
per producer and block of ``BLOCK`` numbers, so a hot producer is spread over its blocks; the ranges seen
before come first in the sorted stream of their block. A fold holds at most ``BLOCK / 2`` ranges of the
block at hand. Only ranges that touch a block's border are compared with those of other blocks.

Defined results: letter case and spaces at the ends of an identifier don't count; a null identifier
is neither a repeat nor kept as a message (``kept`` has none, ``repeats`` has none, ``deduplicated``
keeps the row); an identifier that is empty after trimming is an identifier like any other; ties in the
order are broken by the delivery's own unique id; nulls in the order come last; an empty table gives
empty results; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Producer, one separator, and a number without leading zeros that fits 64 bits; not the form of a UUID, whose last group can be digits by chance.
SEQUENCE_ID = r"^(?!(?:.*[^0-9a-z])?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)(.*[^0-9a-z])(0|[1-9][0-9]{0,17})$"
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS

RANGE_SCHEMA = "producer string, lo bigint, hi bigint"
KEY_SCHEMA = "key string"


@dataclass
class Accepted:
    """kept: key, producer, seq and the id of the delivery kept. ``ranges`` and ``keys``: the state after it.
    ``block_ranges`` and ``new_keys``: what it adds to a state that is only appended to, the ranges being those of
    all blocks touched, cut at their borders."""

    kept: DataFrame
    ranges: DataFrame
    keys: DataFrame
    block_ranges: DataFrame
    new_keys: DataFrame


class SeenRanges:
    """Disjoint, maximal ranges of numbers, in order."""

    def __init__(self) -> None:
        self.lo: list[int] = []
        self.hi: list[int] = []

    def add(self, lo: int, hi: int) -> bool:
        """Merges a range and returns whether any of it was uncovered."""
        at = bisect_right(self.lo, lo) - 1  # the last range that begins at or before lo
        if at >= 0 and self.hi[at] >= hi:
            return False
        first = at if at >= 0 and self.hi[at] >= lo - 1 else at + 1
        last = bisect_right(self.lo, hi + 1)  # ranges first..last-1 are touched
        if first < last:
            lo, hi = min(lo, self.lo[first]), max(hi, self.hi[last - 1])
        self.lo[first:last], self.hi[first:last] = [lo], [hi]
        return True


def _accept_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (producer, block, seq, ...), in order, that the ranges of this task don't cover yet."""
    seen: dict[tuple[str, int], SeenRanges] = {}
    for b in batches:
        mask = [
            seen.setdefault((p, k), SeenRanges()).add(n, n)
            for p, k, n in zip(*(b.column(c).to_pylist() for c in ("producer", "block", "seq")))
        ]
        yield b.filter(pa.array(mask, pa.bool_()))


def _accept_in_blocks(id_type: pa.DataType):
    schema = pa.schema([("producer", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("kept_id", id_type), ("is_range", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, fresh = None, SeenRanges(), False

        def ranges() -> pa.RecordBatch:
            n = len(seen.lo)
            columns = [[at[0]] * n, seen.lo, seen.hi, [None] * n, [True] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            held: list[pa.RecordBatch] = []
            mask = []
            for producer, block, lo, hi, given in zip(*(b.column(c).to_pylist() for c in ("producer", "block", "seq", "hi", "given"))):
                if (producer, block) != at:
                    if fresh:
                        held.append(ranges())
                    at, seen, fresh = (producer, block), SeenRanges(), False
                new = seen.add(lo, hi)
                mask.append(new and not given)
                fresh |= mask[-1]
            kept = b.filter(pa.array(mask, pa.bool_()))
            held.append(pa.RecordBatch.from_arrays([kept.column("producer"), kept.column("seq"), kept.column("seq"), kept.column("kept_id"), pa.array([False] * kept.num_rows)], schema=schema))
            yield from held
        if fresh:
            yield ranges()

    return run


def normalized_id(c: Column) -> Column:
    return F.lower(F.trim(c))


def _parsed(df: DataFrame) -> DataFrame:
    number = F.regexp_extract("key", SEQUENCE_ID, 2)
    return df.withColumns(
        {
            "producer": F.when(number != "", F.regexp_extract("key", SEQUENCE_ID, 1)),
            "seq": F.when(number != "", number).cast("bigint"),
        }
    )


def _blocks(ranges: DataFrame) -> DataFrame:
    """Ranges cut at block borders; a range of n numbers gives n / BLOCK + 2 rows at most."""
    blocks = F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright("hi", BLOCK_BITS)))
    start = F.col("block") * BLOCK
    return ranges.select("producer", "lo", "hi", blocks.alias("block")).select(
        "producer", "block", F.greatest("lo", start).alias("lo"), F.least("hi", start + (BLOCK - 1)).alias("hi")
    )


def _islands(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or adjacent [lo, hi] of one group become one range."""
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("hi").over(before)
    fresh = (reach.isNull() | (F.col("lo") > reach + 1)).cast("int")
    return (
        pieces.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(upto))
        .groupBy(*keys, "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("island")
    )


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint, maximal ranges per producer: first inside each block, then across block borders.

    Only ranges at a border can continue in another block, at most two of each block and producer.
    """
    within = _islands(_blocks(ranges), ["producer", "block"]).select("producer", "lo", "hi")
    at_border = (F.col("lo") % BLOCK == 0) | (F.col("hi") % BLOCK == BLOCK - 1)
    return within.where(~at_border).unionByName(_islands(within.where(at_border), ["producer"]).select("producer", "lo", "hi"))


def accept_once(
    deliveries: DataFrame,
    order: list[str],
    message_id: str = "id",
    delivery_id: str = "delivery_id",
    ranges: DataFrame | None = None,
    keys: DataFrame | None = None,
) -> Accepted:
    """The first delivery of every identifier that the given state doesn't cover, and the new state."""
    from pyspark.sql.pandas.types import to_arrow_type

    ordering = [x for c in order for x in (F.col(c).isNull(), F.col(c))] + [F.col(delivery_id)]
    names = [f"o{i}" for i in range(len(ordering))]
    offered = _parsed(
        deliveries.where(F.col(message_id).isNotNull()).select(
            normalized_id(F.col(message_id)).alias("key"), *[x.alias(n) for n, x in zip(names, ordering, strict=True)]
        )
    )

    block = F.shiftright("seq", BLOCK_BITS)
    numbered = offered.where("seq IS NOT NULL").select("producer", block.alias("block"), "seq", *names)
    local = numbered.sortWithinPartitions(*names).mapInArrow(_accept_in_task, numbered.schema)
    stream = local.select("producer", "block", F.lit(False).alias("given"), "seq", F.col("seq").alias("hi"), *names, F.col(names[-1]).alias("kept_id"))
    if ranges is not None:
        touched = local.select("producer", "block").distinct()
        before = _blocks(ranges).join(touched, ["producer", "block"], "left_semi")
        kinds = {f.name: f.dataType for f in stream.schema}
        stream = stream.unionByName(
            before.select("producer", "block", F.lit(True).alias("given"), F.col("lo").alias("seq"), "hi", *[F.lit(None).cast(kinds[n]).alias(n) for n in [*names, "kept_id"]])
        )
    kind = deliveries.schema[delivery_id].dataType
    folded = (
        stream.repartition("producer", "block")
        .sortWithinPartitions("producer", "block", F.desc("given"), *names)
        .mapInArrow(_accept_in_blocks(to_arrow_type(kind)), f"{RANGE_SCHEMA}, kept_id {kind.simpleString()}, is_range boolean")
    )
    numbers = folded.where(~F.col("is_range")).select(F.concat("producer", F.col("lo").cast("string")).alias("key"), "kept_id", "producer", F.col("lo").alias("seq"))
    block_ranges = folded.where("is_range").select("producer", "lo", "hi")

    first = F.min(F.struct(*names))
    malformed = offered.where("seq IS NULL").groupBy("key").agg(first.alias("first")).select("key", F.col(f"first.{names[-1]}").alias("kept_id"))
    if keys is not None:
        malformed = malformed.join(keys, "key", "left_anti")
    new_keys = malformed.select("key")
    return Accepted(
        kept=numbers.unionByName(malformed.withColumns({"producer": F.lit(None).cast("string"), "seq": F.lit(None).cast("bigint")})),
        ranges=merged_ranges(block_ranges if ranges is None else block_ranges.unionByName(ranges)),
        keys=new_keys if keys is None else new_keys.unionByName(keys),
        block_ranges=block_ranges,
        new_keys=new_keys,
    )


def repeats(
    deliveries: DataFrame, order: list[str], message_id: str = "id", delivery_id: str = "delivery_id"
) -> DataFrame:
    """delivery_id of every row with an identifier that isn't the delivery kept.

    The anti-join is on the unique delivery id, which has no hot value.
    """
    kept = accept_once(deliveries, order, message_id, delivery_id).kept
    return (
        deliveries.where(F.col(message_id).isNotNull())
        .select(delivery_id)
        .join(kept.select(F.col("kept_id").alias(delivery_id)), delivery_id, "left_anti")
    )


def deduplicated(deliveries: DataFrame, order: list[str], message_id: str = "id", delivery_id: str = "delivery_id") -> DataFrame:
    """The rows kept, whole, together with those that have no identifier."""
    kept = accept_once(deliveries, order, message_id, delivery_id).kept
    named = deliveries.where(F.col(message_id).isNotNull()).join(kept.select(F.col("kept_id").alias(delivery_id)), delivery_id, "left_semi")
    return named.unionByName(deliveries.where(F.col(message_id).isNull()))

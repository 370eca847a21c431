"""A streaming source that replays a packet file in slices of time, as a capture would deliver them.

``spark.dataSource.register(PacketReplay)``, then ``readStream.format("packet_replay")`` with ``path`` (a
Parquet file or folder with the columns of ``SCHEMA``) and ``slice_seconds``. As a batch, each row group is a
partition; as a stream, one slice at a time is read, by the row groups that can hold it. Packets without a time are left out. Live capture needs a capture library,
which isn't assumed; a reader for one would replace ``_slice``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "seq bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, flags int, win int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _dataset(path: str):
    import pyarrow.dataset as ds

    return ds.dataset(path.removeprefix("file:"), format="parquet")


def _out(batch) -> Iterator[tuple]:
    import pyarrow as pa

    us = batch.column("ts").cast(pa.timestamp("us", tz=batch.schema.field("ts").type.tz)).cast(pa.int64()).to_pylist()
    for at, row in zip(us, batch.drop_columns(["ts"]).to_pylist()):
        if at is not None:
            yield tuple(datetime.fromtimestamp(at / 1_000_000, tz=timezone.utc) if n == "ts" else row[n] for n in NAMES)


def _slice(path: str, begin: int, length: int) -> list[tuple]:
    """The rows of one slice of time, in order; row groups outside it aren't read."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = _dataset(path)
    kind = data.schema.field("ts").type
    at = lambda us: pa.scalar(us, pa.timestamp("us", tz=kind.tz)).cast(kind)
    table = data.to_table(columns=NAMES, filter=(pc.field("ts") >= at(begin)) & (pc.field("ts") < at(begin + length)))
    return sorted((r for b in table.to_batches() for r in _out(b)), key=lambda r: (r[1], r[0]))


class _Piece(InputPartition):
    """One row group of one file."""

    def __init__(self, file: str, group: int):
        self.file, self.group = file, group


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_Piece(f.path, g) for f in _dataset(self.path).get_fragments() for g in range(f.metadata.num_row_groups)] or [_Piece("", 0)]

    def read(self, partition):
        import pyarrow.parquet as pq

        if partition.file:
            for batch in pq.ParquetFile(partition.file).iter_batches(row_groups=[partition.group], columns=NAMES):
                yield from _out(batch)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.path, self.slice = options["path"], int(float(options.get("slice_seconds", "10")) * 1_000_000)
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause_seconds", "1"))
        self.first, self.last = 0, -1
        found: list[int] = []
        for b in _dataset(self.path).to_batches(columns=["ts"]):
            ends = pc.min_max(b.column("ts").cast(pa.timestamp("us", tz=b.schema.field("ts").type.tz)).cast(pa.int64())).as_py()
            found += [v for v in ends.values() if v is not None]
        if found:
            self.first, self.last = min(found), max(found)

    def initialOffset(self):
        return {"us": self.first}

    def _tried(self, begin: int, length: int) -> list[tuple]:
        """A slice; a read that fails is begun again, up to ``retries`` times."""
        for left in range(self.retries, -1, -1):
            try:
                return _slice(self.path, begin, length)
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause)
        return []

    def read(self, start):
        if start["us"] > self.last:
            return iter([]), start
        return iter(self._tried(start["us"], self.slice)), {"us": start["us"] + self.slice}

    def readBetweenOffsets(self, start, end):
        return iter(self._tried(start["us"], end["us"] - start["us"]))

    def commit(self, end):
        pass


class PacketReplay(DataSource):
    @classmethod
    def name(cls):
        return "packet_replay"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)

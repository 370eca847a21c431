"""Folds over the rows of a key in order, for state that windows can't express.

Rows are partitioned by key and sorted inside their partition; a task streams through them in Arrow
batches and holds the state of one key at a time. A group is never gathered, however long it is. All
rows of a key meet in one task, which the semantics of these operators require.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[Any, dict], tuple[Any, list[tuple]]]


def folded(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, finish: Callable[[Any, tuple], list[tuple]] | None = None) -> DataFrame:
    """Rows that ``step(state, row) -> (state, rows)`` gives, the state being None at the first row of a key.

    ``finish(state, key)`` may add rows after the last one of a key.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, begun = None, None, [], False
        for b in batches:
            for row in b.to_pylist():
                own = tuple(row[k] for k in keys)
                if not begun or own != key:
                    if begun and finish:
                        out += finish(state, key)
                    key, state, begun = own, None, True
                state, rows = step(state, row)
                out += rows
                if len(out) >= 5_000:
                    yield block(out)
                    out = []
        if begun and finish:
            out += finish(state, key)
        if out:
            yield block(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order]).mapInArrow(run, schema)

"""Fixed little-endian headers, identifiers and output formats, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a command header and their bytes.
COMMAND_HEADER = (("opcode", 1), ("flags", 1), ("version", 1), ("reserved", 1), ("seq", 4), ("key_len", 4), ("value_len", 4), ("extra", 8))


def _swapped(digits: Column, size: int) -> Column:
    """Hex digits of ``size`` bytes in the other byte order."""
    return F.concat(*[F.substring(digits, 2 * (size - 1 - i) + 1, 2) for i in range(size)])


def packed(values: dict[str, Column], layout: Sequence[tuple[str, int]] = COMMAND_HEADER) -> Column:
    """Unsigned fields one after the other, little-endian, as binary; null for a null field. A field takes its lowest bytes."""
    parts = [_swapped(F.right(F.lpad(F.hex(values[name].cast("bigint")), 16, "0"), F.lit(2 * size)), size) for name, size in layout]
    return F.unhex(F.concat(*parts))


def unpacked(data: Column, layout: Sequence[tuple[str, int]] = COMMAND_HEADER) -> dict[str, Column]:
    """The fields of a header as bigint; null for data that is shorter. Eight bytes are read as a signed number."""
    out, at, digits = {}, 0, F.hex(data)
    for name, size in layout:
        own = _swapped(F.substring(digits, 2 * at + 1, 2 * size), size)
        value = F.conv(own, 16, -10) if size == 8 else F.conv(own, 16, 10)
        out[name] = F.when(F.length(data) >= sum(n for _, n in layout), value.cast("bigint"))
        at += size
    return out


def stable_uuid(*parts: Column) -> Column:
    """An identifier in the form of a version 4 UUID, the same for the same parts; ``F.uuid()`` draws random ones."""
    h = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def as_json(columns: Sequence[str]) -> Column:
    """A row as one JSON object; null fields are left out."""
    return F.to_json(F.struct(*columns))


def as_raw(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``line``: each row padded to the widest value or name of its columns; the widths come from one aggregation."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    widths = df.agg(*[F.greatest(F.coalesce(F.max(F.length(text[c])), F.lit(0)), F.lit(len(c))).alias(f"__w_{c}") for c in columns])
    cells = [F.rpad(text[c], F.col(f"__w_{c}"), F.lit(" ")) for c in columns]
    return df.join(F.broadcast(widths)).select(*df.columns, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))  # one row of widths

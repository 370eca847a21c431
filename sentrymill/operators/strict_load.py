"""Rows that fail to parse: a strict load, and the remainder with the reason for each failure.

``load`` takes only lines that conform in quoting, number of columns and values, under their
offset. ``rejected`` subtracts the loaded offsets from all offsets by an anti-join and diagnoses
what is left, so that no line can be both loaded and rejected or be neither.

Everything runs as JVM expressions. The patterns use possessive quantifiers, which Java matches
without recursion, so very long fields can't overflow its stack.

Reasons, the first that holds: ``quoting``, ``columns``, ``value``.

Defined results: a null line or null delimiter has no columns and fails with ``columns``; an empty
line has one empty field and fails with ``columns`` unless the layout has one column; fields are
trimmed of spaces before their values are judged, and quoted fields are unquoted before that; a
layout without rows accepts only lines without fields; an empty table gives empty results; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.sources.tables import small_rows

LONG = r"^-?[0-9]+\z"
DOUBLE = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
LAYOUT_BOUND = 2_000
CATALOG_BOUND = 10_000


def _field_pattern(delimiter: Column) -> tuple[Column, Column]:
    """The delimiter as a literal in a pattern, and the pattern of one strictly quoted or plain field."""
    literal = F.concat(F.lit(r"\x{"), F.hex(F.ascii(delimiter)), F.lit("}"))
    field = F.concat(F.lit(r'(?:"(?:[^"]++|"")*+"|[^"'), literal, F.lit("]*+)"))
    return literal, field


def quoting_ok(line: Column, delimiter: Column) -> Column:
    """Every field that begins with a quote also ends with one, and no other field has any."""
    literal, field = _field_pattern(delimiter)
    plain = ~F.contains(line, F.lit('"'))
    return plain | F.regexp_like(line, F.concat(F.lit("(?s)^(?:"), field, F.lit("(?:"), literal, F.lit(r"|\z))*+\z")))


def fields(line: Column, delimiter: Column) -> Column:
    """The fields of a line whose quoting is right, unquoted; null for a null line or delimiter."""
    literal, field = _field_pattern(delimiter)
    quoted = F.transform(
        F.regexp_extract_all(F.concat(delimiter, line), F.concat(F.lit(r"(?s)\G"), literal, F.lit("("), field, F.lit(")")), F.lit(1)),
        lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f),
    )
    plain = F.split(line, literal, -1)
    return F.when(line.isNull() | delimiter.isNull(), F.lit(None)).when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def _value_ok(value: Column, spec, catalog: Sequence[str] | None) -> Column:
    empty = value == ""
    if spec.value_type == "long":
        number = F.when(F.regexp_like(value, F.lit(LONG)), value.try_cast("bigint"))
    elif spec.value_type == "double":
        number = F.when(F.regexp_like(value, F.lit(DOUBLE)), value.try_cast("double"))
    else:
        number = None
    if number is not None:
        ok = number.isNotNull()
        if spec.min_value is not None:
            ok &= number >= F.lit(spec.min_value)
        if spec.max_value is not None:
            ok &= number <= F.lit(spec.max_value)
    elif catalog is not None:
        ok = F.lower(value).isin(list(catalog))
    else:
        ok = F.lit(True)
    return F.when(empty, F.lit(bool(spec.may_be_empty))).otherwise(F.coalesce(ok, F.lit(False)))


class StrictLoader:
    """Loads lines of one layout; ``catalogs`` gives the allowed values of text columns, in any letter case."""

    def __init__(self, layout: DataFrame, catalogs: dict[str, DataFrame] | None = None):
        self.specs = sorted(small_rows(layout, LAYOUT_BOUND), key=lambda r: r.col_no)
        self.catalogs = {
            name: sorted({str(r[0]).strip(" ").lower() for r in small_rows(df.where(F.col(df.columns[0]).isNotNull()), CATALOG_BOUND)})
            for name, df in (catalogs or {}).items()
        }

    def _split(self, raw: DataFrame, line: str, delimiter: str) -> DataFrame:
        ok = F.coalesce(quoting_ok(F.col(line), F.col(delimiter)), F.lit(True))
        parsed = raw.withColumn("__quoting", ok)
        return parsed.withColumn("__fields", F.when(F.col("__quoting"), fields(F.col(line), F.col(delimiter))))

    def _values_ok(self) -> Column:
        ok = F.lit(True)
        for i, spec in enumerate(self.specs):
            ok &= _value_ok(F.trim(F.get("__fields", F.lit(i))), spec, self.catalogs.get(spec.column_name))
        return ok

    def load(self, raw: DataFrame, offset: str = "line_id", line: str = "raw_line", delimiter: str = "delimiter") -> DataFrame:
        """Typed columns of the conforming lines, under their offset. Empty fields are null."""
        kinds = {"long": "bigint", "double": "double"}
        typed = [
            F.nullif(F.trim(F.get("__fields", F.lit(i))), F.lit("")).try_cast(kinds.get(s.value_type, "string")).alias(s.column_name)
            for i, s in enumerate(self.specs)
        ]
        conforming = F.col("__quoting") & F.coalesce(F.size("__fields") == len(self.specs), F.lit(False)) & self._values_ok()
        own = raw.select(offset, line, delimiter)
        return self._split(own, line, delimiter).where(conforming).select(offset, *typed)

    def rejected(self, raw: DataFrame, offset: str = "line_id", line: str = "raw_line", delimiter: str = "delimiter") -> DataFrame:
        """(offset, reason) of every line that ``load`` doesn't take."""
        loaded = self.load(raw, offset, line, delimiter).select(offset)
        remainder = raw.select(offset, line, delimiter).join(loaded, offset, "left_anti")
        reason = (
            F.when(~F.col("__quoting"), F.lit("quoting"))
            .when(F.coalesce(F.size("__fields"), F.lit(-1)) != len(self.specs), F.lit("columns"))
            .otherwise(F.lit("value"))
        )
        return self._split(remainder, line, delimiter).select(offset, reason.alias("reason"))

"""Schemas that drift between files: tagged-union inference over flat JSON rows.

Every file contributes, per field path, the names it was written under and the set of types its
non-null values have (``boolean``, ``integer``, ``decimal``, ``text``). Fusing parallel files keeps
those alternatives side by side instead of widening them away:

* ``file_schemas``: per file and field the names, the alternatives and the type of the file;
* ``changes``: what appears, disappears, is renamed or retyped from a file to the next one of its series;
* ``alternative_changes``: every type that a field's values begin or cease to have from a file to the next one,
  also where the type of the file as a whole stays the same;
* ``fused``: per field all alternatives over all files, and the canonical type that holds them;
* ``converting_types``: per known field the narrowest type that most of its values convert to;
* ``unified``: one row per input row with one canonically typed column per known field, a typed
  branch for each value that the canonical type can't hold, and a map of the fields without alias.

The text of each value is read from the payload itself, since parsed JSON no longer tells ``53`` from
``53.0``. Keys and flags are aggregated before the shuffle: per map task one row for each file and key.

Defined results: a null or non-object payload has no keys, but its file exists; files sent twice or
late are united under their series and number; null series or numbers are values like any other; a
field is compared with the file before in the series, whatever the gap between their numbers; a field
with only null values has no type and is never retyped; a file mixing booleans and numbers without
strings has the numbers' type; a repeated key in one object counts with all its values; an empty table
gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.sources.tables import bounded_broadcast, small_rows

_STRING = r'"(?:[^"\\]++|\\.)*+"'
PAIR = rf'(?s)({_STRING})\s*+:\s*+({_STRING}|[^\s,{{}}\[\]"]++)'
TYPES = ("boolean", "integer", "decimal", "text")
ALIAS_BOUND = 10_000


def folded_name(c: Column) -> Column:
    """A field name without letter case, spaces, underscores, dots and hyphens."""
    return F.translate(F.lower(c), " _.-", "")


def _unquoted(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    escaped = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.contains(token, F.lit("\\")), escaped).otherwise(inner)


def value_type(token: Column) -> Column:
    """The tag of a JSON value as it is written; null for null."""
    return (
        F.when(F.startswith(token, F.lit('"')), F.lit("text"))
        .when(token == "null", F.lit(None).cast("string"))
        .when(token.isin("true", "false"), F.lit("boolean"))
        .when(F.regexp_like(token, F.lit("[.eE]")), F.lit("decimal"))
        .otherwise(F.lit("integer"))
    )


def pairs(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per key of each payload: all columns but the payload, plus name and token (the value as written)."""
    p = F.col(payload)
    names = F.regexp_extract_all(p, F.lit(PAIR), F.lit(1))
    tokens = F.regexp_extract_all(p, F.lit(PAIR), F.lit(2))
    kept = [c for c in rows.columns if c != payload]
    return (
        rows.where(F.startswith(F.ltrim(p), F.lit("{")))
        .select(*kept, F.explode(F.arrays_zip(names.alias("n"), tokens.alias("t"))).alias("kv"))
        .select(*kept, _unquoted(F.col("kv.n")).alias("name"), F.col("kv.t").alias("token"))
    )


def aliases_by_fold(aliases: DataFrame) -> DataFrame:
    """folded -> field; of two fields that claim one folded alias the smaller name wins."""
    return (
        aliases.where("alias IS NOT NULL AND field IS NOT NULL")
        .groupBy(folded_name(F.col("alias")).alias("folded"))
        .agg(F.min("field").alias("alias_field"))
    )


class DriftingFiles:
    """Series of files: ``series`` identifies a series, ``number`` orders it, ``file`` names a file."""

    def __init__(
        self,
        rows: DataFrame,
        aliases: DataFrame,
        series: str = "exporter_id",
        number: str = "file_seq",
        file: str = "file_name",
        row_id: str = "export_row_id",
        payload: str = "payload",
    ):
        self.rows = rows.select(
            F.col(row_id).alias("row_id"),
            F.col(series).alias("series"),
            F.col(number).alias("number"),
            F.col(file).alias("file"),
            F.col(payload).alias("payload"),
        )
        self.row_id, self.series, self.number, self.file = row_id, series, number, file
        by_fold = aliases_by_fold(aliases)
        self._aliases = [(r.folded, r.alias_field) for r in small_rows(by_fold.orderBy("folded"), ALIAS_BOUND)]
        self.by_fold = bounded_broadcast(by_fold, ALIAS_BOUND)
        self.known = [r[0] for r in small_rows(aliases.where("field IS NOT NULL").select("field").distinct().orderBy("field"), ALIAS_BOUND)]

    def _named(self, keyed: DataFrame) -> DataFrame:
        joined = keyed.withColumn("folded", folded_name(F.col("name"))).join(self.by_fold, "folded", "left")
        return joined.withColumn("field", F.coalesce("alias_field", "name")).drop("folded", "alias_field")

    def _keys(self) -> DataFrame:
        tag = value_type(F.col("token"))
        flags = [F.max((tag == t).cast("int")).alias(t) for t in TYPES]
        return pairs(self.rows.select("series", "number", "payload")).groupBy("series", "number", "name").agg(*flags)

    def file_schemas(self) -> DataFrame:
        """series, number, field, names, alternatives, type."""
        fused = (
            self._named(self._keys())
            .groupBy("series", "number", "field")
            .agg(F.sort_array(F.collect_set("name")).alias("names"), *[F.max(t).alias(t) for t in TYPES])
        )
        return fused.select("series", "number", "field", "names", _alternatives().alias("alternatives"), _canonical().alias("type"))

    def files(self) -> DataFrame:
        """series, number, file name and the number of the file after it in the series."""
        files = self.rows.groupBy("series", "number").agg(F.min("file").alias("file"))
        following = Window.partitionBy("series").orderBy("number")
        return files.withColumns({"next": F.lead("number").over(following), "first": F.row_number().over(following) == 1})

    def _both(self) -> tuple[DataFrame, DataFrame]:
        """Each field of a file beside that of the file before: names, types and alternatives now and then; and the files."""
        files = self.files().alias("f")
        fields = self.file_schemas().alias("s")
        placed = fields.join(files, F.col("s.series").eqNullSafe(F.col("f.series")) & F.col("s.number").eqNullSafe(F.col("f.number")))
        role = F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(True).alias("now"), F.col("s.number").alias("at"), ~F.col("f.first")),
                    F.struct(F.lit(False).alias("now"), F.col("f.next").alias("at"), F.col("f.next").isNotNull()),
                ),
                lambda x: x["col3"],
            )
        ).alias("role")
        sided = placed.select(F.col("s.series").alias("series"), "s.field", "s.names", "s.type", "s.alternatives", role)
        now, then = F.col("role.now"), ~F.col("role.now")
        both = sided.groupBy("series", F.col("role.at").alias("number"), "field").agg(
            *[F.max(F.when(when, F.col(c))).alias(f"{c}_{side}") for side, when in (("now", now), ("then", then)) for c in ("names", "type", "alternatives")]
        )
        return both, files

    def alternative_changes(self) -> DataFrame:
        """(file name, field, alternative, change): a type whose first values of the field are in this file (``appeared``) or whose last ones were in the file before (``vanished``)."""
        both, files = self._both()
        kept = both.where("names_now IS NOT NULL AND names_then IS NOT NULL")
        tagged = lambda a, b, change: F.transform(F.array_except(a, b), lambda t: F.struct(t.alias("alternative"), F.lit(change).alias("change")))
        moved = F.concat(tagged("alternatives_now", "alternatives_then", "appeared"), tagged("alternatives_then", "alternatives_now", "vanished"))
        return self._of_file(kept.select("series", "number", "field", F.explode(moved).alias("x")), files).select(
            F.col("f.file").alias(self.file), "b.field", "b.x.alternative", "b.x.change"
        )

    @staticmethod
    def _of_file(both: DataFrame, files: DataFrame) -> DataFrame:
        return both.alias("b").join(files, F.col("b.series").eqNullSafe(F.col("f.series")) & F.col("b.number").eqNullSafe(F.col("f.number")))

    def changes(self) -> DataFrame:
        """(file name, field, change): added, removed, renamed, retyped against the file before in the series."""
        both, files = self._both()
        here, before = F.col("names_now").isNotNull(), F.col("names_then").isNotNull()
        change = F.filter(
            F.array(
                F.when(here & ~before, F.lit("added")),
                F.when(~here & before, F.lit("removed")),
                F.when(here & before & (F.col("names_now") != F.col("names_then")), F.lit("renamed")),
                F.when(here & before & (F.col("type_now") != F.col("type_then")), F.lit("retyped")),
            ),
            lambda x: x.isNotNull(),
        )
        return self._of_file(both, files).select(F.col("f.file").alias(self.file), F.col("b.field").alias("field"), F.explode(change).alias("change"))

    def fused(self) -> DataFrame:
        """Per field over all files: number of files, names, alternatives and the canonical type that holds them."""
        keys = self._named(self._keys())
        return (
            keys.groupBy("field")
            .agg(
                F.count_distinct(F.struct("series", "number")).alias("files"),
                F.sort_array(F.collect_set("name")).alias("names"),
                *[F.max(t).alias(t) for t in TYPES],
            )
            .select("field", "files", "names", _alternatives().alias("alternatives"), _canonical().alias("canonical_type"))
        )

    def converting_types(self) -> DataFrame:
        """Per known field with values the narrowest type that more than half of its non-null values over all rows convert to, else ``text``.

        Numbers 0 and 1 convert to booleans, but a field has that type only if more of its values are
        written as words. Values are counted, so single odd ones don't change a type.
        """
        text, tag = _written(F.col("token"))
        bools = _converted(text, tag, "boolean").isNotNull()
        counts = {
            "values": F.count(tag),
            "bools": F.count_if(bools),
            "words": F.count_if(bools & ~F.trim(text).isin("0", "1")),
            "integers": F.count_if(_converted(text, tag, "integer").isNotNull()),
            "decimals": F.count_if(_converted(text, tag, "decimal").isNotNull()),
        }
        by_name = pairs(self.rows.select("payload")).groupBy("name").agg(*[c.alias(n) for n, c in counts.items()])
        by_field = self._named(by_name).where(F.col("field").isin(self.known)).groupBy("field").agg(*[F.sum(n).alias(n) for n in counts])
        kind = (
            F.when((F.col("bools") * 2 > F.col("values")) & (F.col("words") * 2 > F.col("bools")), F.lit("boolean"))
            .when(F.col("integers") * 2 > F.col("values"), F.lit("integer"))
            .when(F.col("decimals") * 2 > F.col("values"), F.lit("decimal"))
            .otherwise(F.lit("text"))
        )
        return by_field.where("values > 0").select("field", kind.alias("type"))

    def unified(self, canonical: dict[str, str]) -> DataFrame:
        """One row per input row: each known field under one name and type.

        ``canonical`` maps fields to ``text``, ``decimal``, ``integer`` or ``boolean``. A value that the
        canonical type can't hold is null there and stands, as written, in ``branches`` under
        ``field#type``. Fields without alias stand in ``other``. Of a key repeated in one payload the
        greatest value stays. Each row is made from its own payload, so no row moves.
        """
        kinds = {"text": "string", "decimal": "double", "integer": "bigint", "boolean": "boolean"}
        known, fold_of = set(self.known), F.create_map(*[F.lit(x) for r in self._aliases for x in r]) if self._aliases else None
        kind_of = F.create_map(*[F.lit(x) for f in self.known for x in (f, canonical.get(f, "text"))]) if known else None
        p = F.col("payload")
        written = F.arrays_zip(F.regexp_extract_all(p, F.lit(PAIR), F.lit(1)).alias("n"), F.regexp_extract_all(p, F.lit(PAIR), F.lit(2)).alias("t"))
        read = self.rows.withColumn("pairs", F.when(F.startswith(F.ltrim(p), F.lit("{")), written)).drop("payload")

        def entry(e: Column) -> Column:
            name = _unquoted(e["n"])
            text, tag = _written(e["t"])
            field = F.coalesce(F.element_at(fold_of, folded_name(name)), name) if self._aliases else name
            return F.struct(field.alias("field"), text.alias("value"), tag.alias("tag"))

        named = read.withColumn("pairs", F.transform("pairs", entry))
        typed = named.withColumn("pairs", F.transform("pairs", lambda e: e.withField("kind", F.element_at(kind_of, e["field"]) if known else F.lit(None).cast("string"))))

        def column(name: str) -> Column:
            kind = canonical.get(name, "text")
            own = F.filter("pairs", lambda e: e["field"] == name)
            value = lambda e: e["value"] if kind == "text" else _converted(e["value"], e["tag"], kind).cast(kinds[kind])
            return F.array_max(F.transform(own, value)).alias(name)

        def fits(e: Column) -> Column:
            held = [F.when(e["kind"] == k, _converted(e["value"], e["tag"], k).isNotNull()) for k in ("boolean", "integer", "decimal")]
            return F.coalesce(*held, F.lit(True))

        def greatest(entries: Column) -> Column:
            """Entries (key, value) as a map, of equal keys the last in order."""
            ordered = F.array_sort(entries)
            last = F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i + 1)["key"] != e["key"], F.lit(True)))
            return F.map_from_entries(last)

        odd = F.filter("pairs", lambda e: e["kind"].isNotNull() & e["value"].isNotNull() & ~fits(e))
        branches = F.transform(odd, lambda e: F.struct(F.concat_ws("#", e["field"], e["tag"]).alias("key"), e["value"].alias("value")))
        rest = F.transform(F.filter("pairs", lambda e: e["kind"].isNull()), lambda e: F.struct(e["field"].alias("key"), e["value"].alias("value")))
        head = [F.col("row_id").alias(self.row_id), F.col("series").alias(self.series), F.col("number").alias(self.number), F.col("file").alias(self.file)]
        return typed.select(*head, *[column(f) for f in self.known], greatest(branches).alias("branches"), greatest(rest).alias("other"))


def _written(token: Column) -> tuple[Column, Column]:
    """A value's text, null for null, and its tag."""
    tag = value_type(token)
    return F.when(tag == "text", _unquoted(token)).when(tag.isNotNull(), token), tag


def _alternatives() -> Column:
    return F.filter(F.array(*[F.when(F.col(t) == 1, F.lit(t)) for t in TYPES]), lambda x: x.isNotNull())


def _canonical() -> Column:
    return (
        F.when(F.col("text") == 1, F.lit("text"))
        .when(F.col("decimal") == 1, F.lit("decimal"))
        .when(F.col("integer") == 1, F.lit("integer"))
        .when(F.col("boolean") == 1, F.lit("boolean"))
    )


def _converted(value: Column, tag: Column, kind: str) -> Column:
    """Canonical conversion of a value: numbers from numbers and numeric text, booleans from true, false, 0, 1, yes, no."""
    word = F.lower(F.trim(value))
    if kind == "boolean":
        return F.when(word.isin("true", "1", "yes"), F.lit(True)).when(word.isin("false", "0", "no"), F.lit(False))
    if kind == "integer":
        whole = F.regexp_extract(word, r"^(-?[0-9]+)(?:\.0+)?$", 1)
        return F.when(whole != "", whole.try_cast("bigint"))
    return F.when(F.regexp_like(word, F.lit(r"^-?[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?$")), word.try_cast("double"))

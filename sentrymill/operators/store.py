"""Document collections, key-value pairs, lists, sets, sorted sets and hashes over DataFrames.

Collection types are held relationally, one row per element, so that no key gathers its elements in one
value: lists (key, pos, value), sets (key, member), sorted sets (key, member, score), hashes (key, field,
value). Every operation is a pure function from tables to a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOMBSTONE = "\x00DEL\x00"
OPERATORS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "in": lambda c, v: c.isin(*v),
    "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "regex": lambda c, v: F.rlike(c, F.lit(v)),
}


def matches(query: Mapping[str, Any]) -> Column:
    """Conjunction of equalities; a value that is a mapping of operators compares instead. Dotted names are nested fields.

    Null where a comparison meets a null: as a filter that drops the row, and it can be pushed into the scan.
    """
    terms = []
    for name, wanted in query.items():
        c = F.col(name)
        if isinstance(wanted, Mapping):
            terms += [OPERATORS[op](c, v) for op, v in wanted.items()]
        else:
            terms.append(c.isNull() if wanted is None else c == F.lit(wanted))
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def _hit(query: Mapping[str, Any]) -> Column:
    return F.coalesce(matches(query), F.lit(False))


def find(
    docs: DataFrame,
    where: Mapping[str, Any] | None = None,
    project: Sequence[str] | None = None,
    sort: Sequence[tuple[str, int]] = (),
    skip: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Filter, sort (1 ascending, -1 descending), skip, limit and projection, in this order."""
    out = docs.where(matches(where or {}))
    if sort:
        out = out.orderBy(*[F.col(c).asc_nulls_first() if d > 0 else F.col(c).desc_nulls_last() for c, d in sort])
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*project) if project else out


def update(docs: DataFrame, where: Mapping[str, Any], changes: Mapping[str, Any], upsert: bool = False) -> DataFrame:
    """Sets fields of matching documents; with ``upsert`` one document of the equalities and changes is added if none matches."""
    hit = _hit(where)
    out = docs.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})
    if not upsert:
        return out
    plain = {c: v for c, v in where.items() if not isinstance(v, Mapping)} | dict(changes)
    fresh = docs.sparkSession.range(1).select(*[F.lit(plain.get(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])
    none = docs.where(hit).limit(1).select(F.lit(1).alias("__hit"))
    return out.unionByName(fresh.join(none, F.lit(True), "left_anti"))


def delete(docs: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    return docs.where(~_hit(where))


def affected(docs: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    """One row: how many documents a change with this condition touches."""
    return docs.agg(F.count_if(_hit(where)).alias("affected"))


def exists(docs: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    """One row: whether any document meets the condition. Reading stops at the first."""
    return docs.where(_hit(where)).limit(1).agg((F.count("*") > 0).alias("found"))


def duplicates(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that break a unique index, with their count; nulls don't collide."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return docs.where(present).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


class Database:
    """Named collections with index metadata: creating one that exists or dropping one that doesn't raises."""

    def __init__(self) -> None:
        self.collections: dict[str, DataFrame] = {}
        self.indexes: dict[str, dict[str, tuple[tuple[str, int], ...]]] = {}

    def create(self, name: str, docs: DataFrame) -> None:
        if name in self.collections:
            raise ValueError(f"collection {name} exists")
        self.collections[name], self.indexes[name] = docs, {}

    def drop(self, name: str) -> None:
        if name not in self.collections:
            raise KeyError(f"no collection {name}")
        del self.collections[name], self.indexes[name]

    def names(self) -> list[str]:
        return sorted(self.collections)

    def create_index(self, name: str, index: str, fields: Sequence[tuple[str, int]], unique: bool = False) -> None:
        """Records the index; a unique one raises if values collide."""
        if index in self.indexes[name]:
            raise ValueError(f"index {index} exists")
        if unique and not duplicates(self.collections[name], [f for f, _ in fields]).isEmpty():
            raise ValueError(f"values of {index} are not unique")
        self.indexes[name][index] = tuple(fields)

    def drop_index(self, name: str, index: str) -> None:
        del self.indexes[name][index]

    def listed(self, spark) -> DataFrame:
        """collection, index, fields: one row per index, and one without an index for a collection that has none."""
        rows = [
            (name, index, ",".join(f"{f}:{way}" for f, way in fields) if fields else None)
            for name in self.names()
            for index, fields in sorted(self.indexes[name].items()) or [(None, None)]
        ]
        return spark.createDataFrame(rows, "collection string, index string, fields string")

    def ping(self) -> str:
        return "PONG"

    def info(self, spark, version: str = "1") -> DataFrame:
        """Number of collections, indexes and documents."""
        counts = [df.agg(F.count("*").alias("n")) for df in self.collections.values()]
        total = reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("documents")) if counts else spark.range(1).select(F.lit(0).cast("bigint").alias("documents"))
        return total.select(F.lit(len(self.collections)).alias("collections"), F.lit(sum(map(len, self.indexes.values()))).alias("indexes"), "documents", F.lit(version).alias("version"), F.lit(self.ping()).alias("answer"))


class Users:
    """Accounts as a table (name, role): names are unique, roles are from a fixed list."""

    ROLES = ("admin", "read-write", "read-only")

    def __init__(self, users: DataFrame):
        self.users = users.select("name", "role")

    def listed(self) -> DataFrame:
        return self.users

    def created(self, fresh: DataFrame) -> Users:
        """With new accounts; of a name that is there, and of a role that isn't known, the row is left out."""
        known = fresh.where(F.col("name").isNotNull() & F.col("role").isin(*self.ROLES)).groupBy("name").agg(F.min("role").alias("role"))
        return Users(self.users.unionByName(known.join(self.users.select("name"), "name", "left_anti")))

    def deleted(self, names: DataFrame) -> Users:
        return Users(self.users.join(names.select("name"), "name", "left_anti"))

    def with_roles(self, roles: DataFrame) -> Users:
        """With the roles given (name, role) where they are known."""
        fresh = roles.where(F.col("role").isin(*self.ROLES)).groupBy("name").agg(F.min("role").alias("fresh"))
        return Users(self.users.join(fresh, "name", "left").select("name", F.coalesce("fresh", "role").alias("role")))


def with_fallback(spark, read, fallback: DataFrame) -> DataFrame:
    """What ``read(spark)`` gives, or the table held in memory where its store can't be reached."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        return read(spark)
    except (PySparkException, Py4JError, OSError):
        return fallback


def current(writes: DataFrame) -> DataFrame:
    """The live pairs of a write log (key, value, version): the highest version of each key, tombstones left out."""
    newest = writes.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
    return newest.where((F.col("value") != TOMBSTONE) & F.col("value").isNotNull())


def unexpired(pairs: DataFrame, now: Column) -> DataFrame:
    return pairs.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def listed_keys(payload: DataFrame, column: str) -> DataFrame:
    """Keys of newline-separated payloads, empty ones left out."""
    return payload.select(F.explode(F.split(column, "\n")).alias("key")).where("key <> ''")


def cleaned_output(lines: Column) -> Column:
    """Command output without colour codes, blank lines and lines that begin with a time stamp."""
    plain = F.regexp_replace(lines, "\x1b\\[[0-9;]*[A-Za-z]", "")
    kept = F.filter(F.split(plain, "\n"), lambda x: ~F.rlike(x, F.lit(r"^\s*$")) & ~F.rlike(x, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]")))
    return F.array_join(kept, "\n")


# Lists: (key, pos, value) with pos ascending without gaps required between pushes.


def push(lists: DataFrame, items: DataFrame, left: bool = False) -> DataFrame:
    """Appends items (key, ord, value) in order; to the left they go in one by one, so that the last comes first."""
    edge = lists.groupBy("key").agg(F.min("pos").alias("__low"), F.max("pos").alias("__high"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    ranked = items.withColumn("__r", rank).join(edge, "key", "left")
    pos = F.coalesce("__low", F.lit(0)) - F.col("__r") if left else F.coalesce("__high", F.lit(-1)) + F.col("__r")
    return lists.unionByName(ranked.select("key", pos.cast("bigint").alias("pos"), "value"))


def pop(lists: DataFrame, left: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped element of each key, lists left)."""
    pick = F.min_by if left else F.max_by
    popped = lists.groupBy("key").agg(pick("value", "pos").alias("value"), (F.min if left else F.max)("pos").alias("pos"))
    return popped.select("key", "value"), lists.join(popped.select("key", "pos"), ["key", "pos"], "left_anti")


def list_range(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements from start to stop, both included; negative ones count from the end."""
    w = Window.partitionBy("key")
    placed = lists.withColumns({"index": F.row_number().over(w.orderBy("pos")) - 1, "__n": F.count("*").over(w)})
    at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
    return placed.where(F.col("index").between(F.greatest(at(start), F.lit(0)), at(stop))).select("key", "index", "value")


def lengths(elements: DataFrame) -> DataFrame:
    return elements.groupBy("key").agg(F.count("*").alias("n"))


# Sets: (key, member).


def added(sets: DataFrame, members: DataFrame) -> DataFrame:
    return sets.unionByName(members).distinct()


def removed(sets: DataFrame, members: DataFrame) -> DataFrame:
    return sets.join(members, ["key", "member"], "left_anti")


def of_key(sets: DataFrame, key: Any) -> DataFrame:
    return sets.where(F.col("key") == key).select("member").distinct()


def union(sets: DataFrame, key: Any, others: Sequence[Any]) -> DataFrame:
    return sets.where(F.col("key").isin(key, *others)).select("member").distinct()


def intersection(sets: DataFrame, key: Any, others: Sequence[Any]) -> DataFrame:
    """Members that all keys have: one aggregation instead of a chain of joins."""
    keys = {key, *others}
    held = sets.where(F.col("key").isin(*keys)).groupBy("member").agg(F.count_distinct("key").alias("n"))
    return held.where(F.col("n") == len(keys)).select("member")


def difference(sets: DataFrame, key: Any, others: Sequence[Any]) -> DataFrame:
    held = sets.where(F.col("key").isin(key, *others)).groupBy("member").agg(F.max((F.col("key") == key).cast("int")).alias("own"), F.max((F.col("key") != key).cast("int")).alias("other"))
    return held.where("own = 1 AND other = 0").select("member")


# Sorted sets: (key, member, score); order by (score, member).


def scored(zsets: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds members; one that is there gets the new score."""
    return zsets.join(fresh.select("key", "member"), ["key", "member"], "left_anti").unionByName(fresh)


def rank_range(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    w = Window.partitionBy("key")
    placed = zsets.withColumns({"rank": F.row_number().over(w.orderBy("score", "member")) - 1, "__n": F.count("*").over(w)})
    at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
    return placed.where(F.col("rank").between(F.greatest(at(start), F.lit(0)), at(stop))).select("key", "rank", "member", "score")


def removed(zsets: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the members listed (key, member)."""
    return zsets.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def scores(zsets: DataFrame, asked: DataFrame) -> DataFrame:
    """Score of each member asked for (key, member), null for one that isn't there."""
    return asked.select("key", "member").join(zsets.select("key", "member", "score"), ["key", "member"], "left")


def score_range(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zsets.where(F.col("score").between(low, high))


# Hashes: (key, field, value).


def hash_set(hashes: DataFrame, fresh: DataFrame) -> DataFrame:
    return hashes.join(fresh.select("key", "field"), ["key", "field"], "left_anti").unionByName(fresh)


def hash_get(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.where(F.col("field") == field).select("key", "value")


def hash_delete(hashes: DataFrame, fields: Sequence[str]) -> DataFrame:
    return hashes.where(~F.col("field").isin(*fields))


# Documents as VARIANT: typed getters and tagged values.


def typed(doc: Column, path: str, kind: str) -> Column:
    """The value at a path as the type, null where it is missing or of another kind."""
    return F.try_variant_get(doc, path, kind)


def parsed_or_text(text: Column) -> Column:
    """JSON as VARIANT; text that isn't JSON as the VARIANT of the string itself."""
    return F.coalesce(F.try_parse_json(text), F.variant_get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant"))


def untagged(text: Column) -> dict[str, Column]:
    """Type and value of a tagged value {"type": ..., "value": ...}."""
    return {"type": F.get_json_object(text, "$.type"), "value": F.get_json_object(text, "$.value")}


def object_id_time(hex_id: Column) -> Column:
    """Creation time of a 12-byte object id: its first four bytes are seconds."""
    return F.timestamp_seconds(F.conv(F.substring(hex_id, 1, 8), 16, 10).cast("bigint"))

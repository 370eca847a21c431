"""Chats over messages and contacts: threads, ordered reads, searches, timers, event folds, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.operators.ordering import global_index


def threads(contacts: DataFrame, messages: DataFrame, me: str) -> DataFrame:
    """Every contact with its last text and time, unread count and whether a timer is pending; contacts without messages stay.

    Messages belong to the contact that sent them. The newest is taken by a partial maximum.
    """
    own = messages.where(F.col("sender").isNotNull()).groupBy(F.col("sender").alias("id")).agg(
        F.max_by("text", F.struct("timestamp", "delivery_id")).alias("last_text"),
        F.max("timestamp").alias("last_at"),
        F.count_if((F.col("status") != "READ") & (F.col("sender") != me)).alias("unread"),
        F.coalesce(F.max(F.col("self_destruct") & F.col("destruct_at").isNull()), F.lit(False)).alias("pending"),
    )
    joined = contacts.join(own, "id", "left")
    return joined.select("id", "username", "last_text", "last_at", F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("pending", F.lit(False)).alias("pending"))


def last_by_either(contacts: DataFrame, messages: DataFrame) -> DataFrame:
    """The newest message whose chat or sender is the contact: two equi-joins united instead of one with OR."""
    keyed = messages.select(F.explode(F.array_distinct(F.array("chat_id", "sender"))).alias("id"), "timestamp", "delivery_id", "text")
    newest = keyed.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("delivery_id", "text"), F.struct("timestamp", "delivery_id")).alias("m"))
    return contacts.join(newest, "id", "left").select("id", F.col("m.delivery_id").alias("last_delivery"), F.col("m.text").alias("last_text"))


def indexed(index: DataFrame, rows: DataFrame, key: str, ids: str, id_column: str) -> DataFrame:
    """Rows listed in an id array per key, in the array's order (pos); ids without a row are left out."""
    return placed(index.select(key, F.posexplode(ids).alias("pos", id_column)), rows, key, id_column)


def order_index(rows: DataFrame, key: str, order: list[str], id_column: str) -> DataFrame:
    """(key, pos, id): the index of every key as one row per entry, in order. A key with very many entries is sorted by several tasks."""
    at = [F.col(c).asc_nulls_first() for c in order]
    numbered = global_index(rows.where(F.col(key).isNotNull()).select(key, *order, *([id_column] if id_column not in order else [])), [F.col(key), *at], "__i")
    first = numbered.groupBy(F.col(key).alias("__k")).agg(F.min("__i").alias("__first"))
    return numbered.join(first, F.col(key) == F.col("__k")).select(key, (F.col("__i") - F.col("__first")).cast("int").alias("pos"), id_column)


def placed(places: DataFrame, rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows at their places (key, pos, id); ids without a row are left out."""
    return places.join(rows.drop(key) if key in rows.columns else rows, id_column).select(key, "pos", *[c for c in rows.columns if c != key])


def searched(contacts: DataFrame, text: str) -> DataFrame:
    """Contacts whose name or code contains the text in any letter case."""
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return contacts.where(has("username") | has("code"))


def pending_timers(messages: DataFrame, chat: str, me: str) -> DataFrame:
    """Messages of a chat by others whose timer is set and not started."""
    return messages.where((F.col("chat_id") == chat) & F.col("self_destruct") & F.col("destruct_at").isNull() & (F.col("sender") != me))


def opened(messages: DataFrame, condition: Column, at: Column, default_seconds: int = 10) -> DataFrame:
    """Starts the timers of the messages that meet the condition."""
    seconds = F.coalesce("destruct_timer", F.lit(default_seconds))
    until = at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    start = condition & F.col("self_destruct") & F.col("destruct_at").isNull()
    return messages.withColumn("destruct_at", F.when(start, until).otherwise(F.col("destruct_at")))


def alive(messages: DataFrame, now: Column, keep_seconds: int | None = None) -> DataFrame:
    """Messages whose timer hasn't run out and, if given, that are younger than ``keep_seconds``."""
    out = messages.where(F.col("destruct_at").isNull() | (F.col("destruct_at") > now))
    if keep_seconds is not None:
        out = out.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp")) < keep_seconds * 1_000_000)
    return out


def folded_events(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Rows that live after a log of events: a ``delete`` removes, a ``read_receipt`` sets read, others insert once.

    The first insert gives the row; the last delete or insert decides whether it lives. One aggregation.
    """
    at = F.struct(*order)
    is_delete, is_read = F.col(kind) == "delete", F.col(kind) == "read_receipt"
    insert = ~is_delete & ~is_read
    rest = [c for c in events.columns if c not in (key, kind)]
    g = events.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.when(insert, at)).alias("row"),
        F.max(F.when(is_delete, at)).alias("deleted"),
        F.max(F.when(insert, at)).alias("inserted"),
        F.max(F.when(is_read, at)).alias("read"),
    )
    lives = g.where(F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted"))))
    return lives.select(key, "row.*", F.col("read").isNotNull().alias("is_read"))


def lookup_key(email: Column) -> Column:
    return F.sha2(F.lower(email), 256)


def addable(candidates: DataFrame, contacts: DataFrame, me: str) -> DataFrame:
    """Candidates that aren't oneself and whose id and name (any letter case) no contact has."""
    others = candidates.where(F.col("id") != me).withColumn("__name", F.lower("username"))
    known = contacts.select(F.lower("username").alias("__name")).where("__name IS NOT NULL")
    return others.join(contacts.select("id"), "id", "left_anti").join(known, "__name", "left_anti").drop("__name")


def valid_registrations(rows: DataFrame) -> DataFrame:
    """Names of three characters at least, addresses with @, passwords of eight characters at least."""
    return rows.where((F.length("username") >= 3) & F.contains("email", F.lit("@")) & (F.length("password") >= 8))


def bundles(devices: DataFrame, revoked: DataFrame, identity: DataFrame, signed: DataFrame, one_time: DataFrame) -> DataFrame:
    """Key bundle of each device that isn't revoked and has both required keys; the newest one-time key is optional."""
    newest = one_time.groupBy("device_id").agg(F.max_by("one_time_key", "ord").alias("one_time_key"))
    return devices.join(revoked, "device_id", "left_anti").join(identity, "device_id").join(signed, "device_id").join(newest, "device_id", "left")


def incoming(raw: DataFrame) -> DataFrame:
    """Normalized incoming messages: sender from either name, text and flags with defaults, numbers where they parse."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return raw.select(
        text("id").alias("id"),
        F.coalesce(text("sender"), text("sender_id")).alias("sender"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("self_destruct").try_cast("boolean"), F.lit(False)).alias("self_destruct"),
        F.coalesce(F.col("destruct_timer").try_cast("int"), F.lit(0)).alias("destruct_timer"),
    )


def permitted(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests (role, permission) that the role table grants."""
    return requests.join(roles.select("role", "permission").distinct(), ["role", "permission"], "left_semi")


def overridden(rows: DataFrame, order: list[str], replacements: DataFrame) -> DataFrame:
    """Rows in order, their ``ts`` replaced by that of the same position in ``replacements`` (pos, ts) where there is one."""
    from sentrymill.operators.ordering import global_index

    placed = global_index(rows, [F.col(c) for c in order], "pos")
    return placed.join(replacements.select("pos", F.col("ts").alias("__ts")), "pos", "left").withColumn("ts", F.coalesce("__ts", "ts")).drop("__ts")

"""Queries over the document and collection store and over chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators import chat, store
from sentrymill.sources.tables import table


def doc_query(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders")
    return store.find(docs, {"o_orderstatus": "F", "o_totalprice": {"gt": 100_000.0}}, ["o_orderkey", "o_custkey", "o_totalprice"], [("o_totalprice", -1), ("o_orderkey", 1)], 5, 50)


def doc_operators(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer")
    return store.find(docs, {"c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"gte": 0.0, "lt": 5_000.0}, "c_name": {"regex": "7$", "exists": True}, "c_nationkey": {"ne": 3}})


def doc_update_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    once = store.update(docs, {"c_mktsegment": "BUILDING"}, {"c_acctbal": 0.0})
    return store.update(once, {"c_custkey": -1}, {"c_mktsegment": "NEW"}, upsert=True)


def doc_delete(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(table(spark, d, "orders"), {"o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_orderpriority")


def doc_affected(spark: SparkSession, d: str) -> DataFrame:
    return store.affected(table(spark, d, "orders"), {"o_orderpriority": "1-URGENT"})


def unique_index_check(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicates(table(spark, d, "messages"), ["id"])


def _writes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    key = F.concat(F.lit("user:"), F.col("user_id"), F.lit(":"), F.col("event_id") % 7)
    return e.select(key.alias("key"), F.when(F.col("event_type") == "error", store.TOMBSTONE).otherwise(F.col("event_type")).alias("value"), F.col("event_id").alias("version"))


def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.current(_writes(spark, d))


def key_list(spark: SparkSession, d: str) -> DataFrame:
    payload = store.current(_writes(spark, d)).groupBy(F.substring_index("key", ":", 2).alias("u")).agg(F.array_join(F.array_sort(F.collect_list("key")), "\n").alias("payload"))
    return store.listed_keys(payload, "payload")


def kv_expiry(spark: SparkSession, d: str) -> DataFrame:
    kv = table(spark, d, "blocks").select(F.concat(F.lit("block:"), F.col("ip")).alias("key"), F.col("block_id").alias("value"), F.col("auto_unblock_at").alias("expires_at"))
    return store.unexpired(kv, F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")).select("key", "value")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("value"))


def list_range(spark: SparkSession, d: str) -> DataFrame:
    return store.list_range(_lists(spark, d), -5, -2)


def list_push(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.concat(F.lit("new"), F.col("event_id") % 3).alias("value"))
    pushed = store.push(store.push(_lists(spark, d), items, left=True), items)
    return store.list_range(pushed, 0, 3).unionByName(store.list_range(pushed, -2, -1))


def list_pop(spark: SparkSession, d: str) -> DataFrame:
    first, rest = store.pop(_lists(spark, d), left=True)
    last, _ = store.pop(rest)
    return first.withColumnRenamed("value", "first").join(last.withColumnRenamed("value", "last"), "key")


def list_lengths(spark: SparkSession, d: str) -> DataFrame:
    return store.lengths(_lists(spark, d))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()


def set_union(spark: SparkSession, d: str) -> DataFrame:
    return store.union(_sets(spark, d), 1, [2, 3])


def set_inter(spark: SparkSession, d: str) -> DataFrame:
    return store.intersection(_sets(spark, d), 1, [2])


def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return store.difference(_sets(spark, d), 1, [2, 3])


def set_card(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(-1).cast("bigint").alias("member"))
    gone = table(spark, d, "part").where("p_size < 10").select("p_partkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).where("key < 5"), F.lit(True))
    changed = store.removed(store.added(_sets(spark, d), more), gone.select("key", F.col("p_partkey").alias("member")))
    return store.lengths(changed)


def _zsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))


def zrange(spark: SparkSession, d: str) -> DataFrame:
    return store.rank_range(_zsets(spark, d), 0, 4)


def zrange_tail(spark: SparkSession, d: str) -> DataFrame:
    fresh = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).cast("bigint").alias("member"), F.lit(10_000.0).alias("score"))
    return store.rank_range(store.scored(_zsets(spark, d), fresh), -3, -1)


def zrangebyscore(spark: SparkSession, d: str) -> DataFrame:
    return store.score_range(_zsets(spark, d), 45.0, 50.0)


def hash_ops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    hashes = c.unpivot("key", ["name", "segment"], "field", "value")
    fresh = c.where("segment = 'BUILDING'").select("key", F.lit("segment").alias("field"), F.lit("REBUILT").alias("value"))
    return store.hash_get(store.hash_delete(store.hash_set(hashes, fresh), ["name"]), "segment")


def variant_getters(spark: SparkSession, d: str) -> DataFrame:
    doc = store.parsed_or_text(F.col("payload"))
    return table(spark, d, "flow_exports").select(
        "export_row_id", store.typed(doc, "$.dst_port", "bigint").alias("dst_port"), store.typed(doc, "$.duration", "bigint").alias("duration"), store.typed(doc, "$.protocol", "string").alias("protocol")
    )


def object_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lpad(F.lower(F.hex(F.unix_seconds(F.col("ts").cast("timestamp")))), 8, "0"), F.lit("0" * 16)).alias("oid"))
    return e.select("event_id", "oid", F.unix_seconds(store.object_id_time(F.col("oid"))).alias("seconds"))


def output_cleaning(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(store.cleaned_output(F.regexp_replace("text", "\r", ""))).alias("cleaned"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


def chat_threads(spark: SparkSession, d: str) -> DataFrame:
    t = chat.threads(table(spark, d, "contacts"), _messages(spark, d), "u-hub-00")
    return t.select("id", "username", "last_text", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "unread", "pending")


def contact_theta_last(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_by_either(table(spark, d, "contacts"), _messages(spark, d))


def chat_messages_ordered(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    places = chat.order_index(m, "chat_id", ["received_at", "delivery_id"], "delivery_id")
    return chat.placed(places, m.where("text IS NOT NULL"), "chat_id", "delivery_id").select("chat_id", "pos", "delivery_id", "text")


def contact_search(spark: SparkSession, d: str) -> DataFrame:
    return chat.searched(table(spark, d, "contacts"), "STATIC").select("id", "username", "code")


def pending_destruct(spark: SparkSession, d: str) -> DataFrame:
    return chat.pending_timers(_messages(spark, d), "chat-ops-floor", "u-hub-00").select("delivery_id", "sender", "destruct_timer")


def timers_opened(spark: SparkSession, d: str) -> DataFrame:
    o = chat.opened(_messages(spark, d), F.col("status") == "READ", F.lit("2025-05-01 00:00:00").cast("timestamp"))
    return chat.alive(o, F.lit("2025-05-01 01:00:00").cast("timestamp")).select("delivery_id")


def message_event_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        (F.col("event_id") % 997).alias("message"), "event_id", "user_id",
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "read_receipt").otherwise("message").alias("kind"),
    )
    return chat.folded_events(e, "message", ["event_id"], "kind")


def anti_join_new(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "contacts")
    fresh = table(spark, d, "customer").select(F.concat(F.lit("u-hub-0"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("username"))
    return chat.addable(fresh, known, "u-hub-07").select("id", "username")


def user_lookup_hash(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contacts").where("username IS NOT NULL").select("id", chat.lookup_key(F.concat("username", F.lit("@desk"))).alias("lookup"))
    asked = table(spark, d, "contacts").where("username IS NOT NULL").select(chat.lookup_key(F.concat(F.upper("username"), F.lit("@DESK"))).alias("lookup")).distinct()
    return c.join(asked, "lookup").select("id", "lookup")


def write_validation(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "contacts").select("id", "username", F.concat_ws("@", "username", F.when(F.col("verified"), F.lit("desk"))).alias("email"), F.col("code").alias("password"))
    return chat.valid_registrations(r).select("id")


def prekey_bundle(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("device_id"))
    revoked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("device_id"))
    identity = table(spark, d, "customer").select(F.col("c_custkey").alias("device_id"), F.sha2("c_name", 256).alias("identity_key"))
    signed = o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("device_id")).agg(F.max("o_orderkey").alias("signed_key"))
    one_time = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("one_time_key"))
    return chat.bundles(c, revoked, identity, signed, one_time)


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Scored flows whose source is on the block list."""
    f = table(spark, d, "feed")
    return f.join(table(spark, d, "blocks").select(F.col("ip").alias("src_ip")), "src_ip", "left_semi").select("feed_id", "src_ip")


QUERIES = {
    f.__name__: f
    for f in (
        doc_query, doc_operators, doc_update_upsert, doc_delete, doc_affected, unique_index_check, kv_latest, key_list, kv_expiry, list_range, list_push, list_pop,
        list_lengths, set_union, set_inter, set_diff, set_card, zrange, zrange_tail, zrangebyscore, hash_ops, variant_getters, object_times, output_cleaning,
        chat_threads, contact_theta_last, chat_messages_ordered, contact_search, pending_destruct, timers_opened, message_event_fold, anti_join_new,
        user_lookup_hash, write_validation, prekey_bundle, membership,
    )
}

_WRITES = """
w AS (SELECT 'user:' || user_id || ':' || (event_id % 7) AS key, event_type, event_id AS version FROM events),
live AS (SELECT key, arg_max(event_type, version) AS value, max(version) AS version FROM w GROUP BY 1 HAVING arg_max(event_type, version) <> 'error')
"""
_RANGE = "SELECT key, i AS index, value FROM (SELECT user_id AS key, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_ZSET = "z AS (SELECT l_suppkey AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"

SQL = {
    "variant_getters": """SELECT export_row_id, CASE json_type(payload, '$.dst_port') WHEN 'DOUBLE' THEN CAST(trunc(json_extract(payload, '$.dst_port')::DOUBLE) AS BIGINT) WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(json_extract_string(payload, '$.dst_port')), '[+-]?[0-9]+') THEN try_cast(trim(json_extract_string(payload, '$.dst_port')) AS BIGINT) END ELSE try_cast(json_extract_string(payload, '$.dst_port') AS BIGINT) END AS dst_port,
CASE json_type(payload, '$.duration') WHEN 'DOUBLE' THEN CAST(trunc(json_extract(payload, '$.duration')::DOUBLE) AS BIGINT) WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(json_extract_string(payload, '$.duration')), '[+-]?[0-9]+') THEN try_cast(trim(json_extract_string(payload, '$.duration')) AS BIGINT) END ELSE try_cast(json_extract_string(payload, '$.duration') AS BIGINT) END AS duration, json_extract_string(payload, '$.protocol') AS protocol FROM flow_exports""",
    "doc_query": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 5",
    "doc_operators": "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND c_acctbal < 5000 AND regexp_matches(c_name, '7$') AND c_nationkey <> 3",
    "doc_update_upsert": "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer UNION ALL SELECT -1, 'NEW', NULL",
    "doc_delete": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "doc_affected": "SELECT count(*) AS affected FROM orders WHERE o_orderpriority = '1-URGENT'",
    "unique_index_check": "SELECT id, count(*) AS n FROM messages WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "kv_latest": f"WITH {_WRITES} SELECT * FROM live",
    "key_list": f"WITH {_WRITES} SELECT key FROM live",
    "kv_expiry": "SELECT 'block:' || ip AS key, block_id AS value FROM blocks WHERE auto_unblock_at IS NULL OR auto_unblock_at > TIMESTAMP '2025-03-01'",
    "list_range": f"{_RANGE} WHERE i BETWEEN greatest(n - 5, 0) AND n - 2",
    "list_push": """WITH s AS (SELECT user_id AS key, event_id, 'new' || (event_id % 3) AS value FROM events WHERE event_type = 'signup'),
a AS (SELECT key, 0 AS part, -event_id AS o, value FROM s UNION ALL SELECT user_id, 1, event_id, event_type FROM events UNION ALL SELECT key, 2, event_id, value FROM s),
r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY part, o) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM a)
SELECT key, i AS index, value FROM r WHERE i BETWEEN 0 AND 3 UNION ALL SELECT key, i, value FROM r WHERE i BETWEEN greatest(n - 2, 0) AND n - 1""",
    "list_pop": """WITH r AS (SELECT user_id AS key, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT key, any_value(v) FILTER (i = 1) AS first, any_value(v) FILTER (i = n) AS last FROM r WHERE n > 1 GROUP BY 1""",
    "list_lengths": "SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1",
    "set_union": "SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_suppkey IN (1, 2, 3)",
    "set_inter": "SELECT l_partkey AS member FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2",
    "set_diff": "SELECT l_partkey AS member FROM lineitem WHERE l_suppkey = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey IN (2, 3)",
    "set_card": """WITH a AS (SELECT l_suppkey AS key, l_partkey AS member FROM lineitem UNION SELECT s_suppkey, -1 FROM supplier)
SELECT key, count(*) AS n FROM a WHERE NOT (key IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 5) AND member IN (SELECT p_partkey FROM part WHERE p_size < 10)) GROUP BY 1""",
    "zrange": f"WITH {_ZSET} SELECT key, r AS rank, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r FROM z) WHERE r <= 4",
    "zrange_tail": f"""WITH {_ZSET}, y AS (SELECT * FROM z WHERE NOT (member = 1 AND key IN (SELECT s_suppkey FROM supplier)) UNION ALL SELECT s_suppkey, 1, 10000 FROM supplier)
SELECT key, r AS rank, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM y) WHERE r >= greatest(n - 3, 0)""",
    "zrangebyscore": f"WITH {_ZSET} SELECT * FROM z WHERE score BETWEEN 45 AND 50",
    "hash_ops": "SELECT 'customer:' || c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'REBUILT' ELSE c_mktsegment END AS value FROM customer",
    "output_cleaning": """SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(replace(text, chr(13), ''), chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$') AND NOT regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}[T ]')), chr(10))) AS cleaned FROM documents WHERE text IS NOT NULL""",
    "object_times": "SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000000)), 8, '0') || '0000000000000000' AS oid, epoch_us(ts) // 1000000 AS seconds FROM events",
    "chat_threads": """WITH m AS (SELECT sender AS id, arg_max(text, (coalesce(epoch_us(timestamp), -1), delivery_id)) AS last_text, max(epoch_us(timestamp)) AS last_us, count(*) FILTER (status <> 'READ' AND sender <> 'u-hub-00') AS unread,
bool_or(self_destruct AND destruct_at IS NULL) AS pending FROM (SELECT * REPLACE (coalesce(text, chr(1)) AS text) FROM messages) WHERE sender IS NOT NULL GROUP BY 1)
SELECT id, username, nullif(last_text, chr(1)) AS last_text, last_us, coalesce(unread, 0) AS unread, coalesce(pending, false) AS pending FROM contacts LEFT JOIN m USING (id)""",
    "contact_theta_last": """WITH k AS (SELECT chat_id AS id, timestamp, delivery_id, text FROM messages UNION SELECT sender, timestamp, delivery_id, text FROM messages),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp DESC NULLS LAST, delivery_id DESC) AS r FROM k)
SELECT c.id, l.delivery_id AS last_delivery, l.text AS last_text FROM contacts c LEFT JOIN l ON l.id = c.id AND l.r = 1""",
    "chat_messages_ordered": """SELECT chat_id, pos, delivery_id, text FROM (SELECT chat_id, (row_number() OVER (PARTITION BY chat_id ORDER BY received_at NULLS FIRST, delivery_id) - 1)::INT AS pos, delivery_id, text FROM messages WHERE chat_id IS NOT NULL)
WHERE text IS NOT NULL""",
    "contact_search": "SELECT id, username, code FROM contacts WHERE contains(lower(username), 'static') OR contains(lower(code), 'static')",
    "pending_destruct": "SELECT delivery_id, sender, destruct_timer FROM messages WHERE chat_id = 'chat-ops-floor' AND self_destruct AND destruct_at IS NULL AND sender <> 'u-hub-00'",
    "timers_opened": """SELECT delivery_id FROM (SELECT delivery_id, CASE WHEN status = 'READ' AND self_destruct AND destruct_at IS NULL THEN TIMESTAMP '2025-05-01' + to_seconds(coalesce(destruct_timer, 10)) ELSE destruct_at END AS u FROM messages)
WHERE u IS NULL OR u > TIMESTAMP '2025-05-01 01:00:00'""",
    "message_event_fold": """WITH e AS (SELECT event_id % 997 AS message, event_id, user_id, CASE event_type WHEN 'error' THEN 'd' WHEN 'click' THEN 'r' ELSE 'm' END AS k FROM events),
g AS (SELECT message, min(event_id) FILTER (k = 'm') AS first, max(event_id) FILTER (k = 'm') AS ins, max(event_id) FILTER (k = 'd') AS del, max(event_id) FILTER (k = 'r') AS rd FROM e GROUP BY 1)
SELECT g.message, g.first AS event_id, v.user_id, rd IS NOT NULL AS is_read FROM g JOIN events v ON v.event_id = g.first WHERE ins IS NOT NULL AND (del IS NULL OR ins > del)""",
    "anti_join_new": """SELECT id, username FROM (SELECT 'u-hub-0' || c_custkey AS id, c_name AS username FROM customer) WHERE id <> 'u-hub-07' AND id NOT IN (SELECT id FROM contacts)
AND lower(username) NOT IN (SELECT lower(username) FROM contacts WHERE username IS NOT NULL)""",
    "user_lookup_hash": "SELECT id, sha256(lower(username || '@desk')) AS lookup FROM contacts WHERE username IS NOT NULL",
    "write_validation": "SELECT id FROM contacts WHERE length(username) >= 3 AND verified AND length(code) >= 8",
    "prekey_bundle": """WITH s AS (SELECT o_custkey AS device_id, max(o_orderkey) AS signed_key FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), t AS (SELECT o_custkey AS device_id, max(o_orderkey) AS one_time_key FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS device_id, sha256(c_name) AS identity_key, signed_key, one_time_key FROM customer JOIN s ON s.device_id = c_custkey LEFT JOIN t ON t.device_id = c_custkey WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "membership": "SELECT feed_id, src_ip FROM feed WHERE src_ip IN (SELECT ip FROM blocks)",
}

"""Queries over formats, headers, identifiers, layers, optimizers, users, indexes, sorted sets and the packet replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.functions import codec
from sentrymill.functions import scalars as sc
from sentrymill.functions import vectors as v
from sentrymill.operators import layers, learn, state, store
from sentrymill.plans.views import MEASUREMENTS
from sentrymill.sources import files, replay
from sentrymill.sources.tables import scratch, table

NOW = "2025-03-01 00:00:00"


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def output_formats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return codec.as_table(n, n.columns).select("n_nationkey", "line", codec.as_json(n.columns).alias("json"), codec.as_raw("n_name").alias("raw"))


def header_codec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    given = {"opcode": F.col("event_id") % 64, "flags": F.lit(1), "version": F.lit(2), "reserved": F.lit(0), "seq": F.col("event_id"), "key_len": F.length("event_type"), "value_len": F.length("props"), "extra": F.col("user_id")}
    wired = e.select("event_id", codec.packed(given).alias("data"))
    read = codec.unpacked(F.col("data"))
    return wired.select("event_id", F.lower(F.hex("data")).alias("header"), *[read[n].alias(n) for n in ("opcode", "seq", "key_len", "value_len", "extra")])


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return m.select("delivery_id", codec.stable_uuid(F.col("delivery_id"), F.coalesce("chat_id", F.lit(""))).alias("uuid"))


def exponential_delays(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of the delays drawn for all events, against those of the distribution."""
    s = table(spark, d, "events").select(sc.exponential(F.col("event_id"), 40.0).alias("x"))
    near = lambda c, to: F.abs(c / to - 1) < 0.15
    return s.agg(F.count("*").alias("n"), near(F.avg("x"), 40.0).alias("mean_near"), near(F.stddev_pop("x"), 40.0).alias("deviation_near"), (F.min("x") > 0).alias("positive"))


def batch_norm(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "combined_dataset").select("record_id", "dataset_id", "fwd_packets", "duration")
    return layers.batch_normalized(c, "dataset_id", ["fwd_packets", "duration"]).select("record_id", F.round("fwd_packets", 5).alias("fwd_packets"), F.round("duration", 5).alias("duration"))


def batch_norm_running(spark: SparkSession, d: str) -> DataFrame:
    stats = layers.batch_statistics(table(spark, d, "combined_dataset"), "dataset_id", ["fwd_packets", "duration"])
    r = layers.running_statistics(stats, "dataset_id")
    return r.select("column", "dataset_id", F.round("running_mean", 4).alias("running_mean"), F.round(F.sqrt("running_variance"), 1).alias("running_deviation"))


def dropout_residual(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings plus a dropped-out copy of themselves."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = e.select("vec_id", F.posexplode(layers.residual(F.col("v"), layers.dropped_out(F.col("v"), F.col("vec_id"), 0.25))).alias("pos", "x"))
    return out.select("vec_id", "pos", F.round("x", 4).alias("x"))


def optimizer_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("target", F.col("value") / 100)
    return layers.optimized(e, "user_id", "event_id", "target").select("user_id", "optimizer", "steps", F.round("w", 6).alias("w"))


def bandit_arms(spark: SparkSession, d: str) -> DataFrame:
    """Arms chosen per source with the overhead and safety of each arm as reward."""
    f = table(spark, d, "feed").where("malicious_probability IS NOT NULL AND src_ip IS NOT NULL")
    p = F.col("malicious_probability")
    rewards = F.array(*[sc.reward(F.lit(o), 1 - p * s, p > 0.9 + o / 100) for o, s in ((0.0, 1.0), (1.0, 0.6), (2.0, 0.2))])
    return layers.arms_chosen(f.select("src_ip", "feed_id", F.array(F.lit(1.0), p).alias("context"), rewards.alias("rewards")), "src_ip", "feed_id", "context", "rewards").select("src_ip", "feed_id", "arm", F.round("reward", 6).alias("reward"))


def key_care(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("sender IS NOT NULL").groupBy("sender").agg(F.max("timestamp").alias("signed_at"), F.when(F.count("*") > 5, F.count("*")).alias("held"))
    return state.key_care(m, "sender", "signed_at", "held", F.lit(NOW).cast("timestamp_ntz"), 40)


def zset_scores(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))
    large = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("member"))
    gone = z.select("key", "member").join(large, "member", "left_semi")
    asked = table(spark, d, "lineitem").where("l_suppkey <= 3").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()
    return store.scores(store.removed(z, gone), asked)


def index_list(spark: SparkSession, d: str) -> DataFrame:
    db = store.Database()
    db.create("customers", table(spark, d, "customer"))
    db.create("orders", table(spark, d, "orders"))
    db.create("spare", table(spark, d, "region"))
    db.create("gone", table(spark, d, "region"))
    db.create_index("customers", "by_key", [("c_custkey", 1)], unique=True)
    db.create_index("customers", "by_place", [("c_nationkey", 1), ("c_acctbal", -1)])
    db.create_index("orders", "old", [("o_orderdate", 1)])
    db.drop_index("orders", "old")
    db.drop("gone")
    return db.listed(spark)


def store_info(spark: SparkSession, d: str) -> DataFrame:
    db = store.Database()
    for name in ("customer", "orders", "region"):
        db.create(name, table(spark, d, name))
    db.create_index("region", "by_key", [("r_regionkey", 1)], unique=True)
    return db.info(spark)


def user_accounts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("read-only").alias("role"), "c_custkey")
    users = store.Users(c.where("c_custkey % 2 = 0")).created(c.where("c_custkey % 3 = 0").withColumn("role", F.when(F.col("c_custkey") % 9 == 0, "owner").otherwise("read-write")))
    return users.deleted(c.where("c_custkey % 7 = 0")).with_roles(c.where("c_custkey % 5 = 0").withColumn("role", F.lit("read-write"))).listed()


def preprocessed_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The feature matrix written in single precision and read again."""
    path = _scratch(spark, "features")
    files.write_features(table(spark, d, "combined_dataset"), path, MEASUREMENTS[:3], ["record_id", "label_binary"])
    back = spark.read.parquet(path)
    assert all(dict(back.dtypes)[m] == "float" for m in MEASUREMENTS[:3])
    return back.select("record_id", "label_binary", *[F.round(F.col(m).cast("double"), 0).alias(m) for m in MEASUREMENTS[:3]])


def fallback_store(spark: SparkSession, d: str) -> DataFrame:
    """A store that isn't there is stood in for by the table in memory."""
    return store.with_fallback(spark, lambda s: s.read.parquet(f"{d}/no_such_table.parquet"), table(spark, d, "region"))


def packet_replay(spark: SparkSession, d: str) -> DataFrame:
    """feed written as a capture and read by the replaying source."""
    path = _scratch(spark, "capture")
    f = table(spark, d, "feed").where("ts IS NOT NULL AND src_ip IS NOT NULL AND dst_ip IS NOT NULL")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    rows = f.select(F.col("feed_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "src_ip", "dst_ip", *map(whole, ("src_port", "dst_port", "protocol")), F.coalesce("total_packets", F.lit(0)).alias("length"), F.lit(0).alias("flags"), F.lit(0).alias("win"))
    rows.write.parquet(path)
    spark.dataSource.register(replay.PacketReplay)
    return spark.read.format("packet_replay").option("path", path).load().select("seq", F.unix_micros("ts").alias("us"), "src_ip", "dst_ip", "dst_port", "length")


def doc_exists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    asked = {"open": {"o_orderstatus": "O"}, "none": {"o_orderstatus": "?"}}
    found = [store.exists(o, where).select(F.lit(name).alias("name"), "found") for name, where in asked.items()]
    return found[0].unionByName(found[1])


def tensor_apply(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    squashed = v.applied(F.col("embedding").cast("array<double>"), lambda x: x / (1 + F.abs(x)))
    return e.select("vec_id", F.posexplode(squashed).alias("pos", "x")).select("vec_id", "pos", F.round("x", 5).alias("x"))


def estimator_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of learners on their own separable rows."""
    rows = spark.createDataFrame([(i, [float(i), 1.0], float(i > 4)) for i in range(10)], "key int, x array<double>, y double")
    out = [(kind, float(learn.Estimator(kind, max_depth=1).set_params(max_depth=2, **more).fit(rows).score(rows))) for kind, more in (("tree", {}), ("regressor", {}), ("forest", {"trees": 2, "bootstrap": False}), ("boosted", {"rounds": 2}))]
    return spark.createDataFrame(out, "kind string, score double")


QUERIES = {
    f.__name__: f
    for f in (
        output_formats, header_codec, stable_ids, exponential_delays, batch_norm, batch_norm_running, dropout_residual, optimizer_steps, bandit_arms, key_care, zset_scores, index_list, store_info,
        user_accounts, preprocessed_bundle, fallback_store, packet_replay, doc_exists, tensor_apply, estimator_scores,
    )
}

_LE = lambda e, n: "(" + " || ".join(f"lpad(lower(to_hex((({e})::BIGINT >> {8 * i}) & 255)), 2, '0')" for i in range(n)) + ")"

SQL = {
    "bandit_arms": """WITH RECURSIVE f AS (SELECT src_ip, feed_id, malicious_probability::DOUBLE AS p, row_number() OVER (PARTITION BY src_ip ORDER BY feed_id) AS i,
  [CASE WHEN malicious_probability > 0.9 THEN -100 ELSE (1 - malicious_probability) * 10 END, CASE WHEN malicious_probability > 0.9 + 1.0 / 100 THEN -100 ELSE (1 - malicious_probability * 0.6) * 10 - 1 END,
   CASE WHEN malicious_probability > 0.9 + 2.0 / 100 THEN -100 ELSE (1 - malicious_probability * 0.2) * 10 - 2 END]::DOUBLE[] AS rewards FROM feed WHERE malicious_probability IS NOT NULL AND src_ip IS NOT NULL),
r AS (SELECT src_ip, 0::BIGINT AS feed_id, 0::BIGINT AS i, 0 AS arm, 0.0::DOUBLE AS reward, [{'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 1.0::DOUBLE, 'u': 0.0::DOUBLE, 'v': 0.0::DOUBLE} for k in range(3)] AS arms FROM (SELECT DISTINCT src_ip FROM f)
UNION ALL SELECT src_ip, feed_id, i, arm, rewards[arm + 1], list_transform(arms, lambda x, k: CASE WHEN k = arm + 1 THEN
    {'a': x.a - (x.a + x.b * p) ** 2 / q, 'b': x.b - (x.a + x.b * p) * (x.b + x.c * p) / q, 'c': x.c - (x.b + x.c * p) ** 2 / q, 'u': x.u + rewards[k], 'v': x.v + rewards[k] * p} ELSE x END)
FROM (SELECT *, 1 + (arms[arm + 1].a + arms[arm + 1].b * p) + p * (arms[arm + 1].b + arms[arm + 1].c * p) AS q FROM (
  SELECT *, list_position(bounds, list_max(bounds)) - 1 AS arm FROM (
    SELECT f.*, r.arms, list_transform(r.arms, lambda x: round(x.u * (x.a + x.b * f.p) + x.v * (x.b + x.c * f.p) + sqrt(greatest(0.0, (x.a + x.b * f.p) + f.p * (x.b + x.c * f.p))), 12)) AS bounds
    FROM r JOIN f ON f.src_ip = r.src_ip AND f.i = r.i + 1))))
SELECT src_ip, feed_id, arm::INT AS arm, round(reward, 6) AS reward FROM r WHERE i > 0""",
    "doc_exists": "SELECT 'open' AS name, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O') AS found UNION ALL SELECT 'none', EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = '?')",
    "tensor_apply": "SELECT vec_id, pos, round(x / (1 + abs(x)), 5) + 0.0 AS x FROM (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)",
    "estimator_scores": "SELECT kind, 1.0::DOUBLE AS score FROM (VALUES ('tree'), ('regressor'), ('forest'), ('boosted')) AS t(kind)",
    "output_formats": """WITH w AS (SELECT greatest(max(length(n_nationkey::VARCHAR)), 11) AS a, greatest(max(length(n_name)), 6) AS b, greatest(max(length(n_regionkey::VARCHAR)), 11) AS c FROM nation)
SELECT n_nationkey, '| ' || rpad(n_nationkey::VARCHAR, a::INT, ' ') || ' | ' || rpad(n_name, b::INT, ' ') || ' | ' || rpad(n_regionkey::VARCHAR, c::INT, ' ') || ' |' AS line,
to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS json, n_name AS raw FROM nation, w""",
    "header_codec": f"""SELECT event_id, {_LE('event_id % 64', 1)} || '010200' || {_LE('event_id', 4)} || {_LE('length(event_type)', 4)} || {_LE('length(props)', 4)} || {_LE('user_id', 8)} AS header,
event_id % 64 AS opcode, event_id AS seq, length(event_type)::BIGINT AS key_len, length(props)::BIGINT AS value_len, user_id AS extra FROM events""",
    "stable_ids": """WITH h AS (SELECT delivery_id, md5(delivery_id || chr(31) || coalesce(chat_id, '')) AS h FROM messages)
SELECT delivery_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || lower(to_hex(('0x' || substr(h, 17, 1))::INT % 4 + 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
    "exponential_delays": "SELECT count(*) AS n, true AS mean_near, true AS deviation_near, true AS positive FROM events",
    "batch_norm": """WITH s AS (SELECT dataset_id, avg(fwd_packets) AS mf, var_pop(fwd_packets) AS vf, avg(duration) AS md, var_pop(duration) AS vd FROM combined_dataset GROUP BY 1)
SELECT record_id, round((fwd_packets - mf) / sqrt(vf + 1e-5), 5) AS fwd_packets, round((duration - md) / sqrt(vd + 1e-5), 5) AS duration FROM combined_dataset JOIN s USING (dataset_id)""",
    "batch_norm_running": """WITH RECURSIVE s AS (SELECT dataset_id, 'fwd_packets' AS c, avg(fwd_packets) AS m, var_pop(fwd_packets) AS v FROM combined_dataset GROUP BY 1 UNION ALL SELECT dataset_id, 'duration', avg(duration), var_pop(duration) FROM combined_dataset GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY dataset_id) AS i FROM s),
r AS (SELECT c, dataset_id, i, 0.1::DOUBLE * m AS rm, 0.9::DOUBLE + 0.1::DOUBLE * v AS rv FROM o WHERE i = 1 UNION ALL SELECT o.c, o.dataset_id, o.i, 0.9::DOUBLE * r.rm + 0.1::DOUBLE * o.m, 0.9::DOUBLE * r.rv + 0.1::DOUBLE * o.v FROM r JOIN o ON o.c = r.c AND o.i = r.i + 1)
SELECT c AS column, dataset_id, round(rm, 4) AS running_mean, round(sqrt(rv), 1) AS running_deviation FROM r""",
    "dropout_residual": """WITH e AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, pos, round(x + CASE WHEN ('0x' || substr(md5('42:' || vec_id || ':' || pos), 1, 8))::BIGINT / 4294967296.0 >= 0.25 THEN x / 0.75 ELSE 0 END, 4) + 0.0 AS x FROM e""",
    "optimizer_steps": """WITH RECURSIVE e AS (SELECT user_id, value / 100 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
r AS (SELECT user_id, 0::BIGINT AS i, 0.0::DOUBLE AS sw, 0.0::DOUBLE AS mw, 0.0::DOUBLE AS mm, 0.0::DOUBLE AS aw, 0.0::DOUBLE AS am, 0.0::DOUBLE AS av, 0.0::DOUBLE AS rw, 0.0::DOUBLE AS rs, 0.0::DOUBLE AS gw, 0.0::DOUBLE AS gs FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, i, sw - 0.1 * (sw - t), mw - 0.1 * mm1, mm1, aw - 0.1 * (am1 / (1 - 0.9 ** i)) / (sqrt(av1 / (1 - 0.999 ** i)) + 1e-8), am1, av1, rw - 0.1 * (rw - t) / (sqrt(rs1) + 1e-8), rs1, gw - 0.1 * (gw - t) / (sqrt(gs1) + 1e-8), gs1
FROM (SELECT r.user_id, e.i, e.t, sw, mw, aw, rw, gw, 0.9 * mm + (mw - e.t) AS mm1, 0.9 * am + 0.1 * (aw - e.t) AS am1, 0.999 * av + 0.001 * (aw - e.t) ** 2 AS av1, 0.9 * rs + 0.1 * (rw - e.t) ** 2 AS rs1, gs + (gw - e.t) ** 2 AS gs1
      FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT user_id, optimizer, i::INT AS steps, round(w, 6) AS w FROM (SELECT user_id, i, 'sgd' AS optimizer, sw AS w FROM l UNION ALL SELECT user_id, i, 'momentum', mw FROM l UNION ALL SELECT user_id, i, 'adam', aw FROM l
UNION ALL SELECT user_id, i, 'rmsprop', rw FROM l UNION ALL SELECT user_id, i, 'adagrad', gw FROM l)""",
    "key_care": f"""WITH m AS (SELECT sender, max("timestamp") AS s, CASE WHEN count(*) > 5 THEN count(*) END AS held FROM messages WHERE sender IS NOT NULL GROUP BY 1)
SELECT sender, coalesce(epoch_us(TIMESTAMP '{NOW}') // 1000000 - CAST(floor(epoch_us(s) / 1000000) AS BIGINT) > 604800, true) AS rotate, coalesce(held < 40, true) AS replenish FROM m""",
    "zset_scores": """WITH z AS (SELECT l_suppkey AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
a AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem WHERE l_suppkey <= 3)
SELECT a.key, a.member, CASE WHEN p.p_size > 25 THEN NULL ELSE z.score END AS score FROM a LEFT JOIN z USING (key, member) LEFT JOIN part p ON p.p_partkey = a.member""",
    "index_list": "SELECT * FROM (VALUES ('customers', 'by_key', 'c_custkey:1'), ('customers', 'by_place', 'c_nationkey:1,c_acctbal:-1'), ('orders', NULL, NULL), ('spare', NULL, NULL)) AS t(collection, index, fields)",
    "store_info": "SELECT 3 AS collections, 1 AS indexes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM region) AS documents, '1' AS version, 'PONG' AS answer",
    "user_accounts": """WITH u AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'read-only' END WHEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0 THEN 'read-write' END AS role FROM customer)
SELECT name, CASE WHEN k % 5 = 0 THEN 'read-write' ELSE role END AS role FROM u WHERE role IS NOT NULL AND k % 7 <> 0""",
    "preprocessed_bundle": f"SELECT record_id, label_binary, {', '.join(f'round({m}::FLOAT::DOUBLE, 0) AS {m}' for m in MEASUREMENTS[:3])} FROM combined_dataset",
    "fallback_store": "SELECT * FROM region",
    "packet_replay": "SELECT feed_id AS seq, epoch_us(ts) AS us, src_ip, dst_ip, coalesce(dst_port, 0) AS dst_port, coalesce(total_packets, 0) AS length FROM feed WHERE ts IS NOT NULL AND src_ip IS NOT NULL AND dst_ip IS NOT NULL",
}

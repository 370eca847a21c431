"""Small published or derived cases of the operators."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.functions import vectors as v
from sentrymill.functions.stats import text_entropy
from sentrymill.operators import chat, etl, evaluate, flows, neighbours, prepare, scoring, signals, state, store
from sentrymill.operators.ordering import global_index, hashed_rank, running_sum

T = datetime(2025, 1, 1)
PACKET = "seq long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, flags int, win int"


def packets(spark, rows):
    """rows: (seconds, forward, length, flags)"""
    a, b = ("192.168.1.1", "8.8.8.8", 12345, 443), ("8.8.8.8", "192.168.1.1", 443, 12345)
    return spark.createDataFrame([(i, T + timedelta(seconds=s), *(a if f else b), 6, n, fl, 100 + i) for i, (s, f, n, fl) in enumerate(rows)], PACKET)


def test_flow_tap(spark):
    (r,) = flows.flow_tap(packets(spark, [(0, True, 100, 0), (0.00001, True, 200, 0)])).collect()
    assert (r.packets, r.bytes) == (2, 300)


def test_idle_gap_is_strict_and_direction_follows_the_first_packet(spark):
    t = flows.flow_table(packets(spark, [(0, True, 10, 0), (30, False, 10, 0), (60.1, False, 10, 0), (61, True, 10, 0)]), 30)
    got = {(r.segment, r.n_fwd, r.n_bwd, r.src_port, r.close_reason) for r in t.collect()}
    assert got == {(0, 1, 1, 12345, "idle"), (1, 1, 1, 443, "idle")}


def test_terminators_close_after_their_packet(spark):
    t = flows.flow_table(packets(spark, [(0, True, 10, 16), (1, True, 10, 17), (2, False, 10, 16), (3, True, 10, 4)]), 30)
    assert {(r.segment, r.n_all, r.close_reason) for r in t.collect()} == {(0, 2, "fin_rst"), (1, 2, "fin_rst")}


def test_hundred_features_of_one_flow(spark):
    f = flows.flow_features(flows.flow_table(packets(spark, [(0, True, 100, 24), (1, False, 200, 16), (3, True, 300, 16)]), 30))
    assert len(f.columns) == 102
    (r,) = f.collect()
    assert (r.flow_duration, r.total_fwd_packets, r.fwd_pkt_len_std, r.fwd_iat_mean, r.flow_iat_mean, r.bwd_iat_mean) == (3e6, 2, 100, 3e6, 1.5e6, 0)
    assert (r.init_fwd_win_bytes, r.init_bwd_win_bytes, r.fwd_psh_flags, r["flow_bytes/s"]) == (100, 101, 1, 200)
    assert math.isclose(r.total_bytes_log, math.log(601))


def test_parsing_drops_other_traffic_and_clears_fields(spark):
    rows = [(1, T, None, "b", 1, 2, 6, 1, 2, 3), (2, T, "a", "b", 1, 2, 1, 1, 2, 3), (3, T, "a", "b", 1, 2, 17, 1, 2, 3)]
    got = {r.seq: (r.src_port, r.flags) for r in flows.parsed_packets(spark.createDataFrame(rows, PACKET)).collect()}
    assert got == {2: (0, 0), 3: (1, 0)}


def test_bursts(spark):
    p = packets(spark, [(0, True, 1, 0), (0.01, True, 1, 0), (0.025, True, 1, 0), (1, True, 1, 0)]).withColumn("k", F.lit(1))
    (r,) = flows.bursts(p, ["k"], 50_000).collect()
    assert (r.bursts, r.max_size, r.total_duration) == (1, 3, 25_000)


def test_statistics_of_five(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    (r,) = prepare.column_stats(df, ["v"]).collect()
    assert (r.mean, r.max, r.min) == (3, 5, 1) and math.isclose(r.std, math.sqrt(2))


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (3.0, 4.0, 7.0), (5.0, 6.0, 7.0)], "a double, b double, c double")
    s = np.array(prepare.standard_scaled(df, ["a", "b", "c"]).collect())
    assert np.allclose(s.mean(axis=0), 0) and np.allclose(s.std(axis=0), [1, 1, 0])
    assert np.allclose(prepare.minmax_scaled(df, ["a", "c"], -1, 1).select("a", "c").collect(), [[-1, -1], [0, -1], [1, -1]])
    assert np.allclose(prepare.robust_scaled(df, ["a", "c"]).select("a", "c").collect(), [[-1, 0], [0, 0], [1, 0]])


def test_vectors(spark):
    r = spark.range(1).select(
        v.euclidean(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (4, 5, 6)))).alias("d"),
        v.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"),
        v.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"),
    ).first()
    assert math.isclose(r.d, 5.196152422706632) and r.c == 0 and r.s == [0.5, 0.5]


def test_flat_tree(spark):
    t = scoring.FlatTree((0, -1, -1), (0.5, 0, 0), (1, 0, 0), (2, 0, 0), (0, 0.3, 0.8))
    got = [r[0] for r in spark.createDataFrame([(0.2,), (0.5,), (0.6,)], "x double").select(scoring.forest_score([t], [1.0], [F.col("x")])).collect()]
    assert got == [0.3, 0.3, 0.8]
    assert spark.range(1).select(scoring.forest_score([], [], [])).first()[0] == 0


def test_message_scores(spark):
    texts = ["exec(/bin/bash -i); /bin/sh -c 'whoami'", "", None, "x" * 5000, "see 10.0.0.1を", "a" * 41]
    got = scoring.message_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert (got[0].score, got[0].attack_class, round(got[0].entropy, 3)) == (0.45, "Command Injection", 4.067)
    assert got[1].score == got[2].score == 0 and got[1].entropy == 0 and got[1].attack_class == "Benign"
    assert got[3].score == 0.25 and got[4].has_ip is False and got[5].attack_class == "Data Exfiltration"


def test_entropy_matches_counting(spark):
    texts = ["", "a", "abab", "añ😀ñ", "日本日", "x\ny\tz  "]

    def h(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_entropy(F.col("t"))).collect()]
    assert np.allclose(got, [h(t) for t in texts])


def test_multi_signal_score(spark):
    lit = F.lit
    r = spark.range(1).select(
        scoring.multi_signal_score(lit(0), lit(0), lit(0), lit(0), lit(80), lit(200_000_000), lit(200), lit(0.0)), scoring.signal_confidence(lit(20), lit(0), lit(1), lit(19))
    ).first()
    assert np.allclose(r, [0.15 + 0.3 * 0.8, 0.8])


def test_metrics_of_published_counts(spark):
    (r,) = evaluate.rates(spark.createDataFrame([(727461, 3133935, 36227, 20867)], "tp long, tn long, fp long, fn long")).collect()
    assert np.allclose([r.accuracy, r.precision, r.recall, r.f1], [0.985430, 0.952563, 0.972115, 0.962240], atol=1e-6)
    (z,) = evaluate.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp long, tn long, fp long, fn long")).collect()
    assert (z.accuracy, z.precision, z.recall, z.f1) == (0, 0, 0, 0)


def test_auc_of_one_class_and_of_a_ranking(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (2, 0.0, 0.8), (3, 1.0, 0.7), (4, 0.0, 0.1)], "k int, y double, p double")
    assert evaluate.roc_auc(df, F.col("y"), F.col("p"), "k").first()[0] == 0.75
    assert evaluate.roc_auc(df.where("y = 1"), F.col("y"), F.col("p"), "k").first()[0] == 0.5


def test_sampling(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(13)], "k int, y int")
    under = prepare.undersampled(df, "y", "k").groupBy("y").count().collect()
    assert {(r.y, r["count"]) for r in under} == {(0, 3), (1, 3)}
    over = prepare.oversampled(df, "y", "k")
    assert {(r.y, r["count"]) for r in over.groupBy("y").count().collect()} == {(0, 10), (1, 10)}
    assert over.where("y = 1").select("k").distinct().count() == 3


def test_smote_fills_the_minority(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.1, 1.1], 0), *[(i, [5 + i / 10, 5 + i / 10], 1) for i in range(2, 6)]]
    df = spark.createDataFrame(rows, "k int, v array<double>, y int")
    made = neighbours.smote(df, "k", "v", "y", 2).collect()
    assert len(made) == 2 and all(1.0 <= x <= 1.1 for r in made for x in r.vector)
    with pytest.raises(ValueError):
        neighbours.smote(df.where("k <> 0"), "k", "v", "y")


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).round(1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>")
    got = neighbours.nearest(df.where("k % 7 = 0"), df, "k", "v", 4, size=10).collect()
    for q in range(0, 60, 7):
        dist = sorted((np.linalg.norm(x[q] - x[j]), j) for j in range(60) if j != q)[:4]
        assert [r.neighbour for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == [j for _, j in dist]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_in_clusters_with_a_crowded_cell_ties_and_zero_vectors(spark, metric):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.1, rng.normal(size=(60, 3)) * 0.1 + 5, np.repeat([[5.0, 5.0, 5.0]], 4, 0), np.zeros((3, 3))]).round(3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "k int, v array<double>")
    ix = neighbours.Neighbours(df, "k", "v", metric, size=32)
    got = {}
    for r in ix.nearest(df.where("k % 9 = 0"), 5).collect():
        got.setdefault(r.query, {})[r["rank"]] = r[2]
    norm = np.linalg.norm(x, axis=1)
    for q in range(0, len(x), 9):
        if metric == "cosine":
            away = np.array([0.0 if norm[q] < 1e-10 or norm[j] < 1e-10 else -(x[q] @ x[j]) / (norm[q] * norm[j]) for j in range(len(x))])
        else:
            away = np.linalg.norm(x - x[q], axis=1)
        away[q] = np.inf
        want = np.sort(away)[:5] * (-1 if metric == "cosine" else 1)
        assert np.allclose([got[q][i] for i in range(1, 6)], want, atol=1e-9)
    assert ix.distances(df.where("k < 3")).count() == 3 * len(x)


def test_neighbours_of_empty_sets(spark):
    none = spark.createDataFrame([], "k int, v array<double>")
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "k int, v array<double>")
    assert neighbours.nearest(none, df, "k", "v", 2).count() == 0 and neighbours.nearest(df, none, "k", "v", 2).count() == 0
    assert {(r.query, r.neighbour) for r in neighbours.nearest(df, df, "k", "v", 5).collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("n", [1, 2, 7, 40_000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x = rng.lognormal(3, 2, n) if n > 7 else rng.integers(0, 3, n).astype(float)
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "a double, b double")
    got = prepare.quantiles(df, ["a", "b"], (0.0, 0.25, 0.5, 0.75, 0.999, 1.0))
    assert np.allclose(got["a"], np.quantile(x, [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]), rtol=1e-12) and got["b"] == [None] * 6
    assert prepare.quantiles(df.where("a < -1"), ["a"], (0.5,)) == {"a": [None]}


def test_global_order_without_one_task(spark):
    df = spark.range(1000).repartition(7)
    got = running_sum(global_index(df, [F.desc("id")], "i"), [F.col("i")], F.col("id"), "s").orderBy("i").collect()
    assert [r.id for r in got] == list(range(999, -1, -1)) and got[-1].s == sum(range(1000)) and got[1].s == 999 + 998
    ranks = hashed_rank(df.withColumn("g", F.col("id") % 2), ["g"], "id").collect()
    assert sorted(r["rank"] for r in ranks if r.g == 0) == list(range(1, 501))


def test_folds_and_split(spark):
    df = spark.range(11)
    assert [r.fold for r in prepare.folds(df, [F.col("id")], 3).orderBy("id").collect()] == [0] * 3 + [1] * 3 + [2] * 5
    assert prepare.train_test(df, "id", 0.25).where("is_test").count() == 2


def test_tiers_of_one_source():
    s, log = None, []
    for us, score in ((0, 0.1), (1, 0.85), (2, 0.7), (3, 0.99), (301_000_000, 0.7), (301_000_001, 0.95), (301_000_002, 0.95)):
        s, out = state.tier_transition(s, us, score)
        log += [(a, h) for _, a, _, _, h, _ in out]
    assert log == [("T2_RESET", 2), ("T3_TRACK", 3), ("T1_RATE", 3), ("UNBLOCK", 0), ("T3_TRACK", 1), ("T1_BLOCK", 2)]


def test_rate_limit_counts_allowed_calls_only():
    s, out = None, []
    for us in (0, 1, 2, 3, 10, 11, 22):
        s, ok = state.limit_transition(s, us, 2, 10)
        out.append(ok)
    assert out == [True, True, False, False, False, True, True]


def test_batches_flush_when_full_or_late(spark):
    rows = [(i, 1, hop, T + timedelta(milliseconds=ms)) for i, (hop, ms) in enumerate((("a", 0), ("a", 1), ("b", 2), ("a", 3), ("b", 4), ("b", 200)))]
    df = spark.createDataFrame(rows, "o int, lane int, hop string, ts timestamp")
    got = {tuple(r) for r in state.batched(df, "lane", "hop", "ts", "o", 3, 100_000).collect()}
    assert got == {(1, 0, "a", 3, 0), (1, 0, "b", 1, 2), (1, 1, "b", 1, 2), (1, 2, "b", 1, 2)}


def test_stock_and_versions(spark):
    df = spark.createDataFrame([(1, "k", "add", "x"), (2, "k", "add", "y"), (3, "k", "take", None), (4, "k", "take", None), (5, "k", "take", None)], "o int, k string, kind string, item string")
    assert [(r.taken, r.left) for r in state.consumed_keys(df, "k", "o", "kind", "item").orderBy("o").collect()] == [("y", 1), ("x", 0), (None, 0)]
    w = spark.createDataFrame([(1, "k", None, "a"), (2, "k", 0, "b"), (3, "k", 1, "c")], "o int, k string, e long, v string")
    assert [(r.applied, r.version) for r in state.cas_replay(w, "k", "o", "e", "v").orderBy("o").collect()] == [(True, 1), (False, 1), (True, 2)]


def test_chain_breaks_where_it_was_changed(spark):
    e = spark.createDataFrame([("c", i, str(i), "x", f"m{i}") for i in range(4)], "k string, seq long, ts string, category string, message string")
    chain = signals.build_chain(e, "k")
    assert signals.verify_chain(chain, "k").where("linked AND intact").count() == 4
    forged = chain.withColumn("message", F.when(F.col("seq") == 2, "other").otherwise(F.col("message")))
    assert [r.intact for r in signals.verify_chain(forged, "k").orderBy("seq").collect()] == [True, True, False, True]


def test_rhythm_of_a_short_series(spark):
    (r,) = signals.rhythm(spark.createDataFrame([("u", i, float(i)) for i in (1, 2, 3, 4)] + [("u", 9, None), (None, 1, 1.0)], "u string, o int, x double"), ["u"], ["o"], "x").collect()
    assert (r.mean, r.median, r.p25, r.p75, r.iqr, r.mad, r.above_mean, r.mean_step) == (2.5, 2.5, 2, 4, 2, 1, 0.5, 1) and r.bins == [0.25, 0.25, 0, 0.25, 0.25]


def test_taxonomies_and_unions(spark):
    df = spark.createDataFrame([(" Benign ",), ("DDoS",), ("SSH-Patator",), ("XSS",), ("Fuzz",), (None,), ("Background",)], "l string")
    two = df.select(*[c.alias(n) for n, c in etl.taxonomy(F.col("l")).items()]).collect()
    assert [r.label_family for r in two] == [0, 1, 2, 3, 4, 4, 0]
    one = df.select(*[c.alias(n) for n, c in etl.taxonomy(F.col("l"), etl.BENIGN_V1, etl.FAMILIES_V1).items()]).collect()
    assert [r.label_family for r in one] == [0, 1, 4, 4, 4, 4, 4]
    a, b = spark.createDataFrame([(1, None)], "x int, y int"), spark.createDataFrame([(2, "n")], "x int, label_fine string")
    assert {tuple(r) for r in etl.filled_union([a, b]).select("x", "y", "label_fine").collect()} == {(1, 0, None), (2, 0, "n")}
    assert etl.common_union([a, b]).columns == ["x"] and etl.label_column(["a", "Attack_cat", "label"]) == "Attack_cat"


def test_encoders_and_imputation(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", None), (3, "b", 3.0), (4, None, 9.0), (5, "a", 4.0)], "k int, c string, x double")
    assert {r.c: r.n for r in prepare.encoded(df, "c", prepare.label_codes(df, "c"), "n").collect()} == {"a": 0, "b": 1, None: None}
    assert {r.c: r.n for r in prepare.encoded(df, "c", prepare.first_seen_codes(df, "c", "k"), "n").collect()} == {"b": 0, "a": 1, None: None}
    got = {r.k: (r.c, r.x) for r in prepare.imputed(df, ["x"], ["c"]).collect()}
    assert got[4][0] == "a" and got[2][1] == 3.5
    assert prepare.imputed(df.where("k = 4"), [], ["c"]).first().c == "unknown"


def test_correlated_columns_are_dropped_from_the_left(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i % 3), 5.0) for i in range(30)], "a double, b double, c double, d double")
    assert prepare.uncorrelated(df, ["a", "b", "c", "d"], 0.9) == ["a", "c", "d"]


def test_store(spark):
    docs = spark.createDataFrame([("Alice", 30, True), ("Bob", None, False)], "name string, age int, active boolean")
    assert store.find(docs, {"name": "Alice", "age": {"gte": 30}}, ["age"]).collect() == [(30,)]
    assert store.find(docs, {"age": None}).count() == 1 and store.delete(docs, {"age": {"gt": 1}}).count() == 1
    assert store.update(docs, {"name": "Zoe"}, {"age": 1}, upsert=True).count() == 3
    assert store.update(docs, {"name": "Bob"}, {"age": 1}, upsert=True).where("age = 1").count() == 1
    kv = spark.createDataFrame([("k", "a", 1), ("k", store.TOMBSTONE, 3), ("j", "b", 2), ("j", "c", 4)], "key string, value string, version long")
    assert [tuple(r) for r in store.current(kv).collect()] == [("j", "c", 4)]
    db = store.Database()
    db.create("d", docs)
    with pytest.raises(ValueError):
        db.create("d", docs)
    db.create_index("d", "by_name", [("name", 1)], unique=True)
    with pytest.raises(KeyError):
        db.drop("e")
    values = spark.createDataFrame([('{"a": 5, "b": "x"}',), ("plain",)], "t string").select(store.parsed_or_text(F.col("t")).alias("v"))
    got = values.select(store.typed(F.col("v"), "$.a", "int").alias("a"), store.typed(F.col("v"), "$.b", "int").alias("b"), store.typed(F.col("v"), "$", "string").alias("s")).collect()
    assert (got[0].a, got[0].b, got[1].a, got[1].s) == (5, None, None, "plain")


def test_lists_and_sorted_sets(spark):
    ls = spark.createDataFrame([("k", i, c) for i, c in enumerate("abc")], "key string, pos long, value string")
    more = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("n", 1, "z")], "key string, ord int, value string")
    left = store.list_range(store.push(ls, more, left=True), 0, -1).orderBy("key", "index").collect()
    assert [r.value for r in left] == ["y", "x", "a", "b", "c", "z"]
    popped, rest = store.pop(ls)
    assert popped.collect() == [("k", "c")] and rest.count() == 2
    assert [r.value for r in store.list_range(ls, -2, -1).orderBy("index").collect()] == ["b", "c"]
    z = spark.createDataFrame([("k", m, s) for m, s in (("b", 1.0), ("a", 1.0), ("c", 0.5))], "key string, member string, score double")
    assert [r.member for r in store.rank_range(z, 0, 1).orderBy("rank").collect()] == ["c", "a"]
    assert store.score_range(z, 0.5, 1.0).count() == 3


def test_event_fold_and_threads(spark):
    e = spark.createDataFrame([(1, "m1", "message"), (2, "m1", "read_receipt"), (3, "m2", "message"), (4, "m2", "delete"), (5, "m3", "delete"), (6, "m3", "message"), (7, "m1", "message")], "seq int, id string, kind string")
    assert {(r.id, r.seq, r.is_read) for r in chat.folded_events(e, "id", ["seq"], "kind").collect()} == {("m1", 1, True), ("m3", 6, False)}
    contacts = spark.createDataFrame([("c1", "Ann"), ("c2", None)], "id string, username string")
    m = spark.createDataFrame([(1, "c1", "old", T, "SENT", True, None), (2, "c1", "new", T + timedelta(1), "READ", False, None)], "delivery_id long, sender string, text string, timestamp timestamp, status string, self_destruct boolean, destruct_at timestamp")
    got = {r.id: (r.last_text, r.unread, r.pending) for r in chat.threads(contacts, m, "me").collect()}
    assert got == {"c1": ("new", 1, True), "c2": (None, 0, False)}

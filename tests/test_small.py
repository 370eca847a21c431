"""Headers, identifiers, formats, layers, arms, users, fallback and key care."""

from __future__ import annotations

import struct
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.functions import codec
from sentrymill.functions.stats import _row_entropies
from sentrymill.operators import evaluate, layers, learn, state, store


def test_headers_are_little_endian_and_come_back(spark):
    rows = [(1, 2, 3, 4, 70_000, 5, 6, 2**40 + 7), (255, 0, 0, 0, 2**32 - 1, 0, 0, -2), (None, 0, 0, 0, 0, 0, 0, 0)]
    names = [n for n, _ in codec.COMMAND_HEADER]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    out = df.select(codec.packed({n: F.col(n) for n in names}).alias("data")).select("data", *[c.alias(n) for n, c in codec.unpacked(F.col("data")).items()]).collect()
    assert [bytes(r.data) for r in out[:2]] == [struct.pack("<BBBBIIIq", *r) for r in rows[:2]] and out[2].data is None
    assert [tuple(r)[1:] for r in out[:2]] == rows[:2] and out[2].seq is None
    short = spark.createDataFrame([(bytearray(b"abc"),)], "data binary").select(*[c.alias(n) for n, c in codec.unpacked(F.col("data")).items()]).first()
    assert set(short) == {None}


def test_stable_identifiers_are_version_four(spark):
    ids = [r.u for r in spark.range(200).select(codec.stable_uuid(F.col("id")).alias("u")).collect()]
    assert len(set(ids)) == 200 and all(uuid.UUID(u).version == 4 and uuid.UUID(u).variant == uuid.RFC_4122 for u in ids)


def test_formats(spark):
    df = spark.createDataFrame([(1, "a"), (20, None)], "number int, t string")
    assert [r.line for r in codec.as_table(df, df.columns).orderBy("number").collect()] == ["| 1      | a |", "| 20     |   |"]
    assert [r[0] for r in df.orderBy("number").select(codec.as_json(df.columns)).collect()] == ['{"number":1,"t":"a"}', '{"number":20}']
    assert codec.as_table(df.where("number > 99"), df.columns).count() == 0


def test_batch_normalization_keeps_nulls_and_constants(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, 5.0), (None, 7.0)], "b int, x double")
    got = [r.x for r in layers.batch_normalized(df, "b", ["x"]).orderBy("b", "x").collect()]
    assert got[0] == 0.0 and got[1] is None and np.allclose(got[2:], [-1 / np.sqrt(1 + 1e-5), 1 / np.sqrt(1 + 1e-5), 0.0])
    run = {r.b: r for r in layers.running_statistics(layers.batch_statistics(df.where("b IS NOT NULL"), "b", ["x"]), "b").collect()}
    assert np.isclose(run[1].running_mean, 0.2) and np.isclose(run[2].running_mean, 0.68) and np.isclose(run[2].running_variance, 0.9)


def test_dropout_is_stable_and_scaled(spark):
    df = spark.range(300).select("id", F.array_repeat(F.lit(1.0), 10).alias("v"))
    out = df.select(F.explode(layers.dropped_out(F.col("v"), F.col("id"), 0.4)).alias("x"))
    kept = out.where("x > 0").count() / 3000
    assert abs(kept - 0.6) < 0.04 and abs(out.agg(F.max("x")).first()[0] - 1 / 0.6) < 1e-9
    pair = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pair.select(layers.residual(F.col("a"), F.col("b"))).collect()] == [[4.0, 6.0], None, None]


def test_arms_learn_which_pays(spark):
    rows = [(i, "k", [1.0, float(i % 2)], [0.2, 1.0 if i % 2 else 0.0]) for i in range(80)]
    got = layers.arms_chosen(spark.createDataFrame(rows, "o int, k string, c array<double>, r array<double>"), "k", "o", "c", "r", 0.2).orderBy("o").collect()
    assert len(got) == 80 and sum(r.arm == r.o % 2 for r in got[40:]) >= 36


def test_optimizers_follow_the_target(spark):
    df = spark.createDataFrame([("a", i, 2.0) for i in range(400)] + [("b", 0, None)], "k string, o int, t double")
    got = {r.optimizer: r.w for r in layers.optimized(df, "k", "o", "t").collect()}
    assert set(got) == set(layers.OPTIMIZERS) and all(abs(w - 2) < 0.15 for w in got.values())


def test_users_keep_names_unique(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, role string")
    users = store.Users(make([("a", "admin")])).created(make([("a", "read-only"), ("b", "read-only"), ("b", "admin"), ("c", "owner"), (None, "admin")]))
    assert {tuple(r) for r in users.listed().collect()} == {("a", "admin"), ("b", "admin")}
    users = users.with_roles(make([("b", "read-write"), ("a", "emperor")])).deleted(make([("z", "admin")]))
    assert {tuple(r) for r in users.listed().collect()} == {("a", "admin"), ("b", "read-write")}


def test_fallback_and_existence(spark):
    table = spark.range(3)
    assert store.with_fallback(spark, lambda s: s.read.parquet("/no/such/place"), table).count() == 3
    assert store.with_fallback(spark, lambda s: s.range(7), table).count() == 7
    docs = spark.createDataFrame([(1,)], "x int")
    assert [store.exists(docs, {"x": v}).first().found for v in (1, 2)] == [True, False]


def test_keys_are_rotated_after_a_week_and_filled_below_the_threshold(spark):
    now = datetime(2025, 1, 8)
    rows = [("old", now - timedelta(days=7, seconds=1), 10), ("week", now - timedelta(days=7), 9), ("none", None, None)]
    got = {r.k: (r.rotate, r.replenish) for r in state.key_care(spark.createDataFrame(rows, "k string, s timestamp_ntz, n int"), "k", "s", "n", F.lit(now)).collect()}
    assert got == {"old": (True, False), "week": (False, True), "none": (True, True)}


def test_toggles(spark):
    toggles = spark.createDataFrame([(10, False), (20, True), (30, False)], "us long, on boolean")
    got = [r.on for r in spark.range(5, 40, 5).select(state.switched_on(F.col("id"), toggles).alias("on"), "id").orderBy("id").collect()]
    assert got == [True, False, False, True, True, False, False]
    assert spark.range(1).select(state.switched_on(F.col("id"), toggles.where("us < 0")).alias("on")).first().on is True


def test_entropies_of_mixed_alphabets():
    texts = ["", "a", "abab", "héllo wörld", "日本語のテキスト", "x" * 1000, "\U0001f600ab", "\ud800"]
    want = [0.0 if not t else -sum(t.count(c) / len(t) * np.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    assert np.allclose(_row_entropies(texts), want) and len(_row_entropies([])) == 0


def test_searches_and_estimators(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], float(i % 7 > 3)) for i in range(60)], "key int, x array<double>, y double")
    best, scores = learn.searched(df, "x", "y", "key", learn.grid(max_depth=(0, 1, 2)), k=2)
    assert best == {"max_depth": 1} and scores[1][1] == 1.0 == scores[2][1] and scores[0][1] < 0.7
    assert learn.drawn({"a": (1, 2)}, 3) == learn.drawn({"a": (1, 2)}, 3)
    assert abs(learn.Estimator("regressor", max_depth=0).fit(df).score(df)) < 1e-12 and learn.Estimator("tree").set_params(max_depth=1).fit(df).score(df.where("key < 0")) == 0.0
    with pytest.raises(ValueError):
        learn.Estimator("tree").score(df)


def test_value_impurity_with_and_without_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0), (None, 5.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.n, r.median, r.mse, r.mae) for r in evaluate.value_impurity(df, ["k"], "x").collect()}
    assert got == {"a": (4, 4.0, np.var([1, 2, 4, 9]), 2.5), None: (1, 5.0, 0.0, 0.0)}
    (r,) = evaluate.value_impurity(df, [], "x").collect()
    assert (r.n, r.median) == (5, 4.0) and np.isclose(r.mae, 2.2) and evaluate.value_impurity(df.where("x > 99"), [], "x").count() == 0

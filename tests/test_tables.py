"""Access to tables, the shared folder and bounds."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import matrices, typing_rhythm
from sentrymill.functions import scalars
from sentrymill.sources import files
from sentrymill.sources.replay import SCHEMA, PacketReplay
from sentrymill.sources.tables import bounded_broadcast, checkpointed, shared_dir, small_rows, spread


def test_bounds(spark):
    df = spark.range(5)
    assert "broadcast" in bounded_broadcast(df, 5)._jdf.queryExecution().analyzed().toString().lower() and bounded_broadcast(df, 4) is df
    assert len(small_rows(df, 5)) == 5
    with pytest.raises(ValueError):
        small_rows(df, 4)


class Session:
    """The parts of a session that the folder is read from."""

    def __init__(self, configured, current=None, master="spark://cluster"):
        self.dir, self.master = current, master
        self.conf = SimpleNamespace(get=lambda key, default: configured or default)
        self.sparkContext = SimpleNamespace(getCheckpointDir=lambda: self.dir, setCheckpointDir=lambda d: setattr(self, "dir", d), master=master)


def test_configured_folder_comes_first(spark):
    s = Session("/shared")
    assert shared_dir(s) == "/shared" and s.dir == "/shared"
    assert shared_dir(Session("/shared", "/other")) == "/shared" and shared_dir(Session(None, "/other")) == "/other"
    with pytest.raises(ValueError):
        shared_dir(Session(None))
    assert shared_dir(spark) == shared_dir(spark)
    assert checkpointed(spark.range(3)).count() == 3


def test_spread_moves_only_thin_scans(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    thin = spark.read.parquet(str(tmp_path / "t"))
    assert spread(thin).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(thin).count() == 10
    grouped = thin.groupBy("id").count()
    assert spread(grouped) is grouped


def test_mixed_and_broken_files(spark, tmp_path):
    folder = str(tmp_path / "d")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{folder}/a.parquet")
    (tmp_path / "d" / "b.csv").write_text("k,w\n2,x\n3,y\n")
    got = {(r.k, r.v, r.w) for r in files.read_directory(spark, folder).collect()}
    assert got == {(1, "a", None), (2, None, "x"), (3, None, "y")}
    (tmp_path / "bad.csv").write_text("k,v\n1,a\nx,b\n2,c,d\n")
    assert {r.k for r in files.read_csv(spark, str(tmp_path / "bad.csv"), "k int, v string", skip_bad=True).collect()} == {1}
    assert files.with_file(spark.read.parquet(f"{folder}/a.parquet")).select("file_name").first()[0].endswith(".parquet")


def test_replayed_packets_come_in_slices(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2025, 1, 1) + timedelta(seconds=7 * i), "a", "b", 1, 2, 6, 10, 0, 0) for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.dataSource.register(PacketReplay)
    assert spark.read.format("packet_replay").option("path", str(tmp_path / "p")).load().count() == 6
    stream = spark.readStream.format("packet_replay").option("path", str(tmp_path / "p")).option("slice_seconds", "10").load()
    sizes = []
    q = stream.writeStream.foreachBatch(lambda df, i: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(sizes) == 6 and max(sizes) <= 2


def test_a_failed_read_of_the_capture_is_begun_again(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from sentrymill.sources import replay

    spark.createDataFrame([(1, datetime(2025, 1, 1), "a", "b", 1, 2, 6, 10, 0, 0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "p"))
    whole, failures = replay._slice, []

    def shaky(*args):
        if len(failures) < 2:
            failures.append(1)
            raise OSError("gone")
        return whole(*args)

    monkeypatch.setattr(replay, "_slice", shaky)
    stream = replay._Stream({"path": str(tmp_path / "p"), "pause_seconds": "0"})
    rows, after = stream.read(stream.initialOffset())
    assert len(list(rows)) == 1 and len(failures) == 2 and list(stream.read(after)[0]) == []
    failures.clear()
    with pytest.raises(OSError):
        replay._Stream({"path": str(tmp_path / "p"), "pause_seconds": "0", "retries": "1"}).read(stream.initialOffset())


def test_matrices(spark):
    import numpy as np

    a = spark.createDataFrame([(i, j, float(3 * i + j + 1)) for i in range(2) for j in range(3)], "i int, j int, v double")
    b = spark.createDataFrame([(i, j, float(2 * i + j + 1)) for i in range(3) for j in range(2)], "i int, j int, v double")
    assert {(r.i, r.j): r.v for r in matrices.product(a, b).collect()} == {(0, 0): 22, (0, 1): 28, (1, 0): 49, (1, 1): 64}
    m = np.array([[4.0, 7], [2, 6]])
    assert np.allclose(m @ matrices.inverse(m), np.eye(2), atol=1e-8)
    with pytest.raises(ValueError):
        matrices.inverse(np.ones((2, 2)))
    for kind in ("sgd", "momentum", "adam", "rmsprop", "adagrad"):
        o, w = matrices.Optimizer(kind, 0.1), np.array([3.0])
        for _ in range(300):
            w = o.step(w, 2 * w)
        assert abs(w[0]) < 0.7, kind


def test_autoencoder_tells_strange_rows(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 8))
    model = matrices.Autoencoder((6,), 2, 400).fit(x)
    odd = x[:5] + rng.normal(size=(5, 8)) * 6
    assert model.errors(odd).min() > np.percentile(model.errors(x), 95)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>")
    got = {r.k: r.error for r in matrices.reconstruction_errors(model, df, "k", "v").collect()}
    assert np.allclose([got[i] for i in range(80)], model.errors(x))


def test_key_strokes(spark):
    rows = [("u", "a", "down", 0, 1), ("u", "b", "down", 50, 2), ("u", "a", "up", 80, 3), ("u", "b", "up", 120, 4), ("u", "a", "down", 200, 5)]
    s = typing_rhythm.strokes(spark.createDataFrame(rows, "user string, key string, kind string, at long, id int"), ["user"], ["id"])
    assert [(r.key, r.dwell, r.flight) for r in s.orderBy("pressed").collect()] == [("a", 80, None), ("b", 70, -30), ("a", None, 80)]
    assert typing_rhythm.digraphs(s, ["user"], ["id"]).first().digraphs == [-30, 80, 0, 0, 0]


def test_codes_and_readings(spark):
    names = ["", "a", "hello world", "é😀", "polygenelubricants"]

    def h(t):
        n = 0
        for u in t.encode("utf-16-be").hex(" ", 2).split():
            n = (n * 31 + int(u, 16)) % 2**32
        return n - 2**32 if n >= 2**31 else n

    got = [r[0] for r in spark.createDataFrame([(t,) for t in names], "t string").select(scalars.polynomial_hash(F.col("t"))).collect()]
    assert got == [h(t) for t in names] and got[-1] == -(2**31)
    out = scalars.link_reading(F.lit("Radio type : 802.11n 5GHz\nSignal : 90%\n")) | scalars.ping_reading(F.lit("no answer")) | {"drift": scalars.clock_drift(F.lit("Root Delay: 0.03s"))}
    r = spark.range(1).select(*[c.alias(n) for n, c in out.items()]).first()
    assert (r.ssid, r.snr_db, r.latency_ms, r.jitter_ms, r.packet_loss_pct, r.drift) == ("Wi-Fi", 35.0, 999.0, 0.0, 100.0, 30.0)


def test_autoencoder_is_fitted_on_all_rows(spark, tmp_path):
    import numpy as np

    from sentrymill.plans.function_queries import autoencoder_errors

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_300, 3)) @ rng.normal(size=(3, 8))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.error for r in autoencoder_errors(spark, str(tmp_path)).collect()}
    assert np.allclose([got.pop(i) for i in range(len(x))], matrices.Autoencoder(epochs=60).fit(x).errors(x), atol=2e-6) and not got

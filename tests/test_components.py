"""Four tables that change in one step: crashes, rival writers, repeated batches, untouched buckets."""

import os

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import components as CO, training as TR
from fluxwarden.sources import components as C
from fluxwarden.sources.components import ComponentStore, add, put, remove

BASE = ("base", [0.5, 0.25])
STATUS = "device_mac string, current_size long, distinct_hour_buckets array<long>, distinct_day_buckets array<long>, progress double, description string"


def filled(spark, root, devices=12):
    """Devices d0..: every third trained, with a threshold of the older rule for odd ones."""
    store = ComponentStore(spark, str(root), buckets=8)
    macs = spark.range(devices).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("device_mac"), "id")
    done = F.col("id") % 3 == 0
    none = F.array().cast("array<bigint>")
    store.commit({
        "status": put(macs.select(
            "device_mac", F.when(done, 5).otherwise(2).cast("long").alias("current_size"), none.alias("distinct_hour_buckets"),
            none.alias("distinct_day_buckets"), F.when(done, 1.0).otherwise(0.5).alias("progress"), F.lit("").alias("description"),
        )),
        "thresholds": put(macs.select("device_mac", (0.1 + F.col("id")).alias("threshold"), F.when(F.col("id") % 2 == 1, "0.8").otherwise("0.9").alias("version"))),
        "models": put(macs.select("device_mac", F.concat(F.lit("m"), F.col("id")).alias("digest"), F.array(F.lit(1.0), F.lit(2.0)).alias("params"))),
        "datasets": put(macs.select("device_mac", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("x"))),
    })
    return store


def everything(store, state=None):
    return {t: sorted(map(str, store.read(t, state=state).collect())) for t in C.TABLES}


def devices(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "device_mac string")


def test_reset_changes_four_tables_and_only_their_devices(spark, tmp_path):
    store = filled(spark, tmp_path)
    before = everything(store)
    CO.reset(store, devices(spark, "d1", "d3"), *BASE)
    after = everything(store)
    for table in C.TABLES:
        assert [r for r in after[table] if "'d1'" not in r and "'d3'" not in r] == [r for r in before[table] if "'d1'" not in r and "'d3'" not in r]
    two = devices(spark, "d1", "d3")
    assert store.read("datasets", two).count() == 0
    assert {(r.digest, tuple(r.params)) for r in store.read("models", two).collect()} == {("base", (0.5, 0.25))}
    assert {(r.threshold, r.version) for r in store.read("thresholds", two).collect()} == {(0.0001, "0.9")}
    assert {(r.progress, r.current_size) for r in store.read("status", two).collect()} == {(0.0, 0)}
    assert everything(store, store.state(1)) == before  # readers of the earlier commit


def test_a_crash_between_the_writes_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = filled(spark, tmp_path)
    before = everything(store)
    write, tables = ComponentStore._write, []

    def crash(self, table, *rest):
        write(self, table, *rest)
        tables.append(table)
        if len(tables) == 2:
            raise RuntimeError("driver lost")

    monkeypatch.setattr(ComponentStore, "_write", crash)
    with pytest.raises(RuntimeError):
        CO.reset(store, devices(spark, "d1", "d3"), *BASE)
    monkeypatch.setattr(ComponentStore, "_write", write)
    assert store.state().version == 1 and everything(store) == before
    CO.reset(store, devices(spark, "d2"), *BASE)  # the next change writes over the remains
    after = everything(store)
    assert [r for r in after["models"] if "'d2'" not in r] == [r for r in before["models"] if "'d2'" not in r]
    assert len(after["datasets"]) == 33


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    store = filled(spark, tmp_path)
    base = store.state()
    store.commit({"thresholds": put(devices(spark, "d1").select("device_mac", F.lit(7.0).alias("threshold"), F.lit("0.9").alias("version")))}, base)
    with pytest.raises(C.Conflict):
        store.commit({"datasets": remove(devices(spark, "d2"))}, base)
    assert store.state().version == 2 and store.read("datasets", devices(spark, "d2")).count() == 3
    assert not [n for n in os.listdir(tmp_path / "commits") if n.startswith(".") and not n.endswith(".crc")]


def test_files_of_other_buckets_stay_and_are_vacuumed_when_dead(spark, tmp_path):
    store = filled(spark, tmp_path, 40)
    parts = store.state().parts["status"]
    CO.reset(store, devices(spark, "d1"), *BASE)
    changed = {b for b, v in store.state().parts["status"].items() if v != parts[b]}
    assert changed == store._buckets_of(devices(spark, "d1"))
    now = everything(store)
    assert store.vacuum() == 4 and everything(store) == now and store.vacuum() == 0
    assert store.state(1).version == 0  # the first record is gone


def test_repeated_batches_and_many_small_parts(spark, tmp_path):
    store = filled(spark, tmp_path)
    for batch in range(C.MAX_PARTS + 2):
        for _ in range(2 if batch in (0, 3) else 1):
            store.commit({"datasets": add(devices(spark, "d5").withColumn("x", F.lit(100 + batch)))}, writer="stream", batch=batch)
    rows = sorted(r.x for r in store.read("datasets", devices(spark, "d5")).collect())
    assert rows == [1, 2, 3, *range(100, 100 + C.MAX_PARTS + 2)]
    assert max(len(v) for v in store.state().parts["datasets"].values()) <= C.MAX_PARTS
    with pytest.raises(ValueError):
        store.commit({"datasets": add(devices(spark, "d5").withColumn("y", F.lit(1)))})


def test_ensure_starts_new_and_broken_devices(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path), buckets=4)
    CO.ensure(store, devices(spark, "a", "b"), *BASE)
    assert CO.ensure(store, devices(spark, "a", "b"), *BASE).version == 1  # nothing to do: no commit
    store.commit({"models": put(devices(spark, "a").select("device_mac", F.lit("own").alias("digest"), F.array(F.lit(9.0)).alias("params")))})
    assert {r.device_mac: r.reason for r in CO.audit(store, "base").collect()} == {"a": "not started with changed model", "b": None}
    CO.ensure(store, devices(spark, "a", "b", "c"), *BASE)
    assert {r.device_mac: r.digest for r in store.read("models").collect()} == dict.fromkeys("abc", "base")
    assert not CO.audit(store, "base").filter("reason is not null").count()


def test_failed_recomputation_resets(spark, tmp_path):
    store = filled(spark, tmp_path)  # stale: odd devices; trained: 3 and 9
    scores = spark.range(400).select(F.lit("d3").alias("device_mac"), F.col("id").alias("score_seq"), (F.col("id") % 97 / 100.0).alias("score"))
    CO.refresh_thresholds(store, scores, *BASE)
    found = {r.device_mac: (r.threshold, r.version) for r in store.read("thresholds").collect()}
    assert {v for _, v in found.values()} == {"0.9"}
    assert found["d9"] == (0.0001, "0.9") and store.read("datasets", devices(spark, "d9")).count() == 0  # no scores: reset
    assert found["d1"][0] == 1.1 and found["d0"][0] == 0.1 and found["d3"][0] not in (3.1, 0.0001)
    assert store.read("datasets", devices(spark, "d3")).count() == 3


def test_collected_data_and_status_move_together(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path), buckets=4)
    CO.ensure(store, devices(spark, "a", "b"), *BASE)
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("z", 1)], "device_mac string, x int")
    activity = rows.groupBy("device_mac").agg(F.lit(7).cast("long").alias("hour_bucket"), F.lit(0).cast("long").alias("day_bucket"), F.count("*").alias("windows"))
    for batch in (0, 0, 1):
        CO.collect(store, rows, activity, "features", batch)
    status = {r.device_mac: r for r in store.read("status").collect()}
    assert status["a"].current_size == 10 == store.read("datasets").count() and set(status) == {"a", "b"}
    trained = spark.createDataFrame([("a", "own", [1.0, 2.0]), ("b", "own", [1.0, 2.0])], "device_mac string, digest string, params array<double>")
    CO.finish_training(store, trained, spark.createDataFrame([("a", 0.3)], "device_mac string, threshold double"))
    assert {r.device_mac: r.progress for r in store.read("status").collect()} == {"a": 1.0, "b": 0.0}
    assert {r.device_mac: r.digest for r in store.read("models").collect()} == {"a": "own", "b": "base"}
    assert TR.THRESHOLD_VERSION == "0.9"


def test_a_table_of_no_rows_can_be_read(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.read("status")
    store.commit({"status": put(spark.createDataFrame([], STATUS))})
    assert store.read("status").count() == 0 and store.read("status", devices(spark, "a")).columns[0] == "device_mac"

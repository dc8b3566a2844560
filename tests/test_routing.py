"""Fan-out of feature rows by action, rules refreshed between batches, and stores that change only what they must."""

import os

from pyspark.sql import functions as F

from fluxwarden.operators import features as FT, models as M, scoring as SC, training as TR
from fluxwarden.plans.pipeline import Registry, score_features
from fluxwarden.sources import stores
from fluxwarden.streaming import routing, rules as SR

DAY = 86_400_000_000


def feature_rows(spark, rows):
    """(capture, device, window): features that differ by window."""
    df = spark.createDataFrame(rows, "capture_id long, device_mac string, windowid long")
    value = lambda i: (F.pmod(F.xxhash64("device_mac", "windowid", F.lit(i)), F.lit(1000)) / 1000).alias(FT.FEATURES[i])
    return df.select("*", *[value(i) for i in range(len(FT.FEATURES))])


def make_registry(spark):
    status = spark.createDataFrame(
        [("a", 0, [], [], 1.0, ""), ("b", 10, [1], [0], 0.1, ""), ("c", 4000, [1], [0], 0.96, "")],
        "device_mac string, current_size long, distinct_hour_buckets array<long>, distinct_day_buckets array<long>, progress double, description string",
    )
    models = M.flat_models(M.layer_table(spark.createDataFrame([("a", 0, [0.0] * 45)], "device_mac string, vec_seq long, vector array<double>")))
    return Registry(devices=status.select("device_mac"), status=status, models=models, thresholds=status.select("device_mac", F.lit(0.25).alias("threshold")))


def plain(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rows_of_each_action_in_their_store_only(spark, tmp_path):
    registry, root = make_registry(spark), str(tmp_path / "out")
    first = [(1, d, k * 20_000_000) for d in "abc" for k in range(12)]
    second = [(2, d, DAY + k * 20_000_000) for d in "abz" for k in range(12)]
    route = routing.route_batch(spark, lambda: registry, root)
    for batch_id, rows in ((0, first), (0, first), (1, second), (1, second)):  # every batch is repeated
        route(feature_rows(spark, rows), batch_id)
    assert plain(routing.read_sink(spark, root, "dataset"), "device_mac", "windowid") == sorted((d, w) for _, d, w in first + second if d == "b")
    assert plain(routing.read_sink(spark, root, "training"), "device_mac") == [("c",)]
    status = {r.device_mac: r for r in stores.newest_snapshot(spark, f"{root}/status")[1].collect()}
    assert set(status) == {"a", "b", "c"}
    assert status["b"].current_size == 10 + 24 and sorted(status["b"].distinct_day_buckets) == [0, 1] and sorted(status["b"].distinct_hour_buckets) == [0, 1, 24]
    assert (status["a"].progress, status["c"].current_size) == (1.0, 4000)
    flags = routing.read_sink(spark, root, "scores")
    whole = score_features(feature_rows(spark, [r for r in first + second if r[1] == "a"]), registry.models, registry.thresholds)
    key = ("capture_id", "device_mac", "score_seq", "is_anomaly")
    assert plain(flags, *key) == plain(whole, *key)  # two batches with a tail between them, or all at once
    assert plain(stores.newest_snapshot(spark, f"{root}/tail")[1], "score_seq") == plain(SC.score_tail(whole, bits=36), "score_seq")


def test_a_device_that_has_enough_data_waits_for_training(spark, tmp_path):
    registry = make_registry(spark)
    registry.status = registry.status.withColumn("current_size", F.lit(4395).cast("long")).withColumn("progress", F.lit(0.9))
    route = routing.route_batch(spark, lambda: registry, str(tmp_path))
    route(feature_rows(spark, [(1, "b", k * 20_000_000) for k in range(12)]), 0)
    assert plain(routing.read_sink(spark, str(tmp_path), "training"), "device_mac") == [("b",)]
    assert routing.read_sink(spark, str(tmp_path), "scores").count() == 0
    off = routing.route_batch(spark, lambda: registry, str(tmp_path / "off"), training_enabled=False)
    off(feature_rows(spark, [(1, "b", 0)]), 0)
    assert routing.read_sink(spark, str(tmp_path / "off"), "dataset").count() == 0
    assert TR.COLLECTED == 0.95


def test_rules_added_between_batches(spark, tmp_path):
    rule = 'alert udp any any -> any any (msg:"{0}"; content:"{0}"; sid:{1}; rev:1;)'
    root, published, source = str(tmp_path / "out"), str(tmp_path / "rules"), str(tmp_path / "events")
    schema = "event_id long, proto string, src_ip long, dst_ip long, event_src_port int, event_dst_port int, buffers map<string,string>"

    def events(ids):
        rows = [(i, "udp", 1, 2, 3, 4, {"payload": "first second"}) for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        SR.start_rules(stream, published, root, str(tmp_path / "cp"), once=True).awaitTermination(120)
        return plain(spark.read.parquet(f"{root}/hits"), "version", "rule_sid", "hits", "rules_version")

    SR.publish_rules(spark.createDataFrame([(rule.format("first", 1),)], "line string"), published, 1)
    events(range(3))
    assert run() == [(0, 1, 3, 1)]
    SR.publish_rules(spark.createDataFrame([(rule.format("first", 1),), (rule.format("second", 2),)], "line string"), published, 2)
    events(range(3, 5))
    assert run() == [(0, 1, 3, 1), (1, 1, 2, 2), (1, 2, 2, 2)]
    # a repeated batch meets the rules that it noted
    SR.rule_batch(spark, published, root)(spark.read.schema(schema).parquet(source).filter("event_id < 3"), 0)
    assert plain(spark.read.parquet(f"{root}/hits"), "version", "rule_sid", "hits", "rules_version") == [(0, 1, 3, 1), (1, 1, 2, 2), (1, 2, 2, 2)]


def test_clearing_features_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(400).select(F.concat(F.lit("d"), F.col("id") % 20).alias("device_mac"), F.col("id").alias("windowid"))
    stores.append_features(rows, path, buckets=8)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    gone = spark.createDataFrame([("d3",)], "device_mac string")
    touched = gone.select(stores.device_bucket(buckets=8)).first()[0]
    stores.clear_features(spark, path, gone, buckets=8)
    after = files()
    mark = f"device_bucket={touched}/"
    assert {f for f in before if mark not in f} == {f for f in after if mark not in f}
    left = {r.device_mac for r in spark.read.parquet(path).select("device_mac").distinct().collect()}
    assert left == {f"d{k}" for k in range(20)} - {"d3"}
    # a bucket whose devices are all cleared is empty, not left as it was
    same = rows.select("device_mac").distinct().filter(stores.device_bucket(buckets=8) == touched)
    stores.clear_features(spark, path, same, buckets=8)
    assert not [f for f in files() if mark in f]
    assert stores.load_features(spark, path).count() == rows.join(same, "device_mac", "left_anti").count()

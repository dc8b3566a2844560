"""Stores, snapshots, threshold refresh and the joined pipeline."""

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import models as M, thresholds as T, training as TR
from fluxwarden.plans import packet_queries as Q, pipeline, synthetic
from fluxwarden.plans.fixtures import view
from fluxwarden.operators import features as FT
from fluxwarden.sources import stores

SF = "/root/testdata/sf0.001"


def test_feature_store_append_load_clear(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('d', id % 4) as device_mac", "id", "id * 1.5 as x")
    path = str(tmp_path / "features")
    stores.append_features(rows.filter("id < 20"), path)
    stores.append_features(rows.filter("id >= 20"), path)
    some = spark.createDataFrame([("d1",), ("d3",)], "device_mac string")
    assert sorted(r.id for r in stores.load_features(spark, path, some).collect()) == [i for i in range(40) if i % 2]
    stores.clear_features(spark, path, some)
    assert sorted(r.id for r in stores.load_features(spark, path).collect()) == [i for i in range(40) if i % 2 == 0]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "status")
    assert stores.newest_snapshot(spark, root) is None
    for version in (1, 3, 12):
        stores.write_snapshot(spark.range(version), root, version)
    assert stores.newest_snapshot(spark, root)[0] == 12
    version, rows = stores.newest_snapshot(spark, root, before=12)
    assert version == 3 and rows.count() == 3


def test_corrupt_model_loads_as_null(spark, tmp_path):
    stores.save_models(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "device_mac string, params array<double>"), str(tmp_path / "m"))
    assert {r.device_mac: r.params for r in stores.load_models(spark, str(tmp_path / "m"), 2).collect()} == {"a": [1.0, 2.0], "b": None}


def test_only_stale_thresholds_are_recomputed(spark):
    scores = view(spark, SF, "scores")
    actions = spark.createDataFrame(
        [("aa-bb-cc-00-00-00", 0.5, "recompute"), ("aa-bb-cc-00-00-01", 0.25, "bump"), ("aa-bb-cc-00-00-02", 0.1, "keep")],
        "device_mac string, threshold double, threshold_action string",
    )
    got = {r.device_mac: r for r in TR.refresh_thresholds(actions, scores).collect()}
    whole = {r.device_mac: r.threshold for r in T.final_threshold(scores.filter("device_mac = 'aa-bb-cc-00-00-00'")).collect()}
    assert set(got) == {"aa-bb-cc-00-00-00", "aa-bb-cc-00-00-01"}
    assert got["aa-bb-cc-00-00-00"].threshold == pytest.approx(whole["aa-bb-cc-00-00-00"])
    assert got["aa-bb-cc-00-00-01"].threshold == 0.25 and {r.version for r in got.values()} == {"0.9"}


def test_captures_to_report(spark):
    frames = view(spark, SF, "raw_frames")
    captures = synthetic.capture_files(frames)
    registry = view(spark, SF, "device_registry")
    analysis = pipeline.analyse_captures(captures, registry, Q._geo(spark, SF))
    total = analysis.totals.agg(F.sum("packets")).first()[0]
    assert total == analysis.packets.count() == analysis.traffic.agg(F.sum("packet_count")).first()[0]
    features = FT.window_features(Q._registered(spark, SF))
    models = M.flat_models(M.layer_table(registry))
    limits = registry.select("device_mac", F.lit(0.01).alias("threshold"))
    flags = pipeline.score_features(features, models, limits)
    assert flags.count() == features.count()
    status = registry.select("device_mac", F.lit(1.0).alias("progress"))
    alerts = view(spark, SF, "alert_events").withColumn("macs", F.when(F.col("has_ether"), F.array("src_mac", "dest_mac")))
    report = pipeline.merged_report(registry, alerts, pipeline.verdicts(flags, status)).collect()
    assert len(report) == 8 and all(r.ml.type in ("Alert", "Normal") and len(r.suricata) > 0 for r in report)

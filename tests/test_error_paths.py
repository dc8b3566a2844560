"""Results where data, models or captures are missing or damaged."""

from pyspark.sql import functions as F

from fluxwarden.operators import models as M, report as R, thresholds as TH, traffic as T
from fluxwarden.plans import pipeline


def test_reader_errors_stand_first(spark):
    labelled = spark.createDataFrame([(1, "accepted", 60), (2, "accepted", 60)], "capture_id int, disposition string, frame_len int")
    captures = spark.createDataFrame([(1,), (2,), (3,), (4,)], "capture_id int")
    failures = spark.createDataFrame([(2, "cut off"), (3, "unreadable")], "capture_id int, read_error string")
    got = {r.capture_id: (r.packets, r.error) for r in T.capture_totals(labelled, captures, failures).collect()}
    assert got == {1: (1, None), 2: (1, "cut off"), 3: (0, "unreadable"), 4: (0, T.NO_PACKETS)}


def test_silent_devices_have_an_empty_map(spark):
    traffic = spark.createDataFrame([("a", "1.1.1.1", "X", 10, 1)], "device_mac string, remote_ip string, country string, data_volume_bytes int, packet_count int")
    registry = spark.createDataFrame([("a",), ("b",), ("b",)], "device_mac string")
    got = {r.device_mac: set(r.external_ips) for r in T.nested_traffic(traffic, registry=registry).collect()}
    assert got == {"a": {"1.1.1.1"}, "b": set()}


def test_damaged_model_leaves_others_scored(spark):
    vectors = spark.createDataFrame([(d, k, [0.1 * k] * 45) for d in "ab" for k in range(5)], "device_mac string, vec_seq long, vector array<double>")
    models = M.flat_models(M.layer_table(vectors))
    damaged = models.withColumn("params", F.when(F.col("device_mac") == "a", F.col("params")))
    got = {(r.device_mac, r.vec_seq): r.score for r in M.score_windows(vectors, damaged).collect()}
    assert len(got) == 10
    assert all((score is not None) == (device == "a") for (device, _), score in got.items())


def test_verdicts_of_missing_data_and_models(spark):
    flags = spark.createDataFrame([("a", 0.1, False), ("b", None, None), ("c", None, None)], "device_mac string, score double, is_anomaly boolean")
    status = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.1), ("d", 1.0)], "device_mac string, progress double")
    found = pipeline.verdicts(flags, status)
    got = {r.device_mac: (r.description, r.error) for r in found.collect()}
    assert got == {"a": ("No Anomalies detected", None), "b": ("Error occured", pipeline.NO_MODEL), "c": ("", None)}
    alerts = spark.createDataFrame([], "device_mac string, suricata array<struct<x:int>>")
    report = R.join_reports(status.select("device_mac"), alerts, found).collect()
    assert sorted(r.ml.description for r in report) == ["", "Error occured", "No Anomalies detected", "No data"]


def test_gap_threshold_of_few_scores(spark):
    scores = spark.createDataFrame([("a", k, 0.01 * k) for k in range(20)], "device_mac string, score_seq long, score double")
    value = TH.gap_threshold(scores).first().threshold
    assert value is not None and 0.1 < value <= 0.2


def test_first_occurrence_follows_the_files(spark, tmp_path):
    import json
    import os

    from fluxwarden.operators import alerts as A
    from fluxwarden.sources import files

    for k, rows in enumerate((3, 50, 4000)):  # Spark reads the largest, which is the newest, first
        path = tmp_path / f"eve-{9 - k}.json"
        event = {"event_type": "alert", "alert": {"signature": "s"}, "ether": {"src_mac": "AA:BB:CC:00:00:01"}}
        path.write_text("".join(json.dumps(event | {"timestamp": f"2024-01-0{k + 1}T00:00:{j % 60:02d}+0000"}) + "\n" for j in range(rows)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    registry = spark.createDataFrame([("aa-bb-cc-00-00-01", 0)], "device_mac string, position int")
    found = A.alert_rollup(A.alert_device(A.only_alerts(files.read_alerts(spark, str(tmp_path))), registry)).first()
    assert found.number_occurrences == 4053
    assert found.first_occurrence == 1_704_067_200_000_000

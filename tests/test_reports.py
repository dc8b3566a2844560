"""Reports of captures: both sides joined in batch and stream, errors, late, missing and repeated sides."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import capture_report as CR, traffic as T
from fluxwarden.plans import pipeline
from fluxwarden.streaming import reports as SR

NOON = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
ML = {"type": "Normal", "description": "No Anomalies detected", "score": 1.5}


@pytest.fixture(scope="module")
def devices(spark):
    rows = [(0, "aa-01", 1), (0, "aa-02", 0), (1, "bb-01", 0)]
    return spark.createDataFrame(rows, "site_id long, device_mac string, position long")


def rule_rows(spark, rows):
    """(capture, minutes after noon, error, [(device, signature)])"""
    entry = lambda s: {"type": "Alert", "description": s, "first_occurrence": 5, "number_occurrences": 2, "score": 100}
    data = [
        (c, NOON + dt.timedelta(minutes=m), e, {"suricataTotalRules": "7"}, [{"device_mac": d, "suricata": [entry(s)]} for d, s in alerts])
        for c, m, e, alerts in rows
    ]
    return spark.createDataFrame(data, SR.RULE_SIDE.format(kind="bigint"))


def model_rows(spark, rows):
    """(capture, site, minutes after noon, error, [device])"""
    data = [
        (c, site, NOON + dt.timedelta(minutes=m), e, {"packets": "3", "suricataTotalRules": "from the right"}, [{"device_mac": d, "ml": ML} for d in found])
        for c, site, m, e, found in rows
    ]
    return spark.createDataFrame(data, SR.MODEL_SIDE.format(kind="bigint"))


RULE = [(1, 0, None, [("aa-01", "x"), ("zz-99", "y")]), (2, 1, "engine failed", [("aa-01", "x")]), (3, 2, None, [])]
MODEL = [(1, 0, 1, None, ["aa-02", "zz-99"]), (2, 0, 1, None, ["aa-01"]), (3, 1, 4, None, ["bb-01"])]


def plain(df):
    return {r.capture_id: r.asDict(recursive=True) for r in df.collect()}


def test_batch_reports(spark, devices):
    rule, model = rule_rows(spark, RULE + [(4, 0, None, [])]).drop("arrived"), model_rows(spark, MODEL + [(5, 0, 0, "x", [])]).drop("arrived")
    got = plain(CR.compose(CR.pair(rule, model), devices))
    assert set(got) == {1, 2, 3, 4, 5}
    first = got[1]
    assert first["result"] == {"status": "success", "message": ""}
    assert first["statistics"] == {"packets": "3", "suricataTotalRules": "from the right"}
    assert [d["mac"] for d in first["detections"]] == ["AA:02", "AA:01"]  # registry order; strangers are left out
    assert first["detections"][0] == {"mac": "AA:02", "suricata": [], "ml": ML}
    assert [a["description"] for a in first["detections"][1]["suricata"]] == ["x"]
    assert first["detections"][1]["ml"] == {"type": "Normal", "description": "No data", "score": 0.0}
    for capture, message in ((2, {"rb": "engine failed", "ml": ""}), (4, {"rb": "", "ml": CR.NO_MODEL_RESULT}), (5, {"rb": CR.NO_RULE_RESULT, "ml": "x"})):
        assert got[capture]["result"]["status"] == "error" and json.loads(got[capture]["result"]["message"]) == message
        assert got[capture]["statistics"] is None and got[capture]["detections"] is None
    assert [d["mac"] for d in got[3]["detections"]] == ["BB:01"]
    document = json.loads(CR.as_document(CR.compose(CR.pair(rule, model), devices).filter("capture_id = 2")).first().report)
    assert set(document) == {"file", "result"}


def test_sides_from_rows(spark, devices):
    captures = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "capture_id long, site_id long")
    traffic = spark.createDataFrame([(1, "aa-01", 134744072, "US", 2, 80), (1, "aa-01", 16843009, "AU", 1, 60)], "capture_id long, device_mac string, remote_ip long, country string, packet_count long, data_volume_bytes long")
    labelled = spark.createDataFrame([(1, "accepted", 80)] * 3 + [(3, "not_ipv4", 60)], "capture_id long, disposition string, frame_len int")
    totals = T.capture_totals(labelled, captures, spark.createDataFrame([(2, "cut off")], "capture_id long, read_error string"))
    verdicts = spark.createDataFrame([(1, "aa-01", "Alert", "2 Anomalies detected", 60.0)], "capture_id long, device_mac string, type string, description string, score double")
    side = plain(CR.model_side(captures, devices, totals, traffic, verdicts))
    assert {c: s["model_error"] for c, s in side.items()} == {1: None, 2: "cut off", 3: T.NO_VALID_PACKETS.format(1)}
    sent = json.loads(side[1]["model_statistics"]["devices"])
    assert [d["mac"] for d in sent] == ["AA:02", "AA:01"]
    assert sent[0] == {"mac": "AA:02", "external": {}, "data_volume": {"packet_count": 0, "data_volume_bytes": 0}}
    assert sent[1]["data_volume"] == {"packet_count": 3, "data_volume_bytes": 140}
    assert set(sent[1]["external"]) == {"8.8.8.8", "1.1.1.1"}
    assert side[1]["verdicts"] == [{"device_mac": "aa-01", "ml": {"type": "Alert", "description": "2 Anomalies detected", "score": 60.0}}]
    assert side[3]["verdicts"] == []
    rollup = spark.createDataFrame([(1, "aa-01", "s", 5, 2), (1, None, "s", 5, 2), (1, "aa-01", "r", 9, 1)], "capture_id long, device_mac string, signature string, first_occurrence long, number_occurrences long")
    runs = spark.createDataFrame([(1, None, {"suricataTotalRules": "7"}), (2, "failed", None)], "capture_id long, rule_error string, rule_statistics map<string,string>")
    rules = plain(CR.rule_side(runs, rollup))
    assert [(a["device_mac"], [x["description"] for x in a["suricata"]]) for a in rules[1]["alerts"]] == [("aa-01", ["r", "s"])]
    assert rules[2] == {"capture_id": 2, "rule_error": "failed", "rule_statistics": None, "alerts": []}


def test_verdicts_by_capture(spark):
    flags = spark.createDataFrame([(1, "a", 0.1, True), (2, "a", 0.1, False), (2, "b", None, None)], "capture_id long, device_mac string, score double, is_anomaly boolean")
    status = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "device_mac string, progress double")
    got = {(r.capture_id, r.device_mac): r.description for r in pipeline.verdicts(flags, status, keys=CR.DEVICE).collect()}
    assert got == {(1, "a"): "1 Anomalies detected", (2, "a"): "No Anomalies detected", (2, "b"): "Error occured"}


def run(spark, devices, tmp_path):
    rule, model = (SR.read_sides(spark, str(tmp_path / n), s) for n, s in (("rule", SR.RULE_SIDE), ("model", SR.MODEL_SIDE)))
    SR.start_reports(rule, model, lambda: devices, str(tmp_path / "out"), str(tmp_path / "cp"), "10 minutes", once=True).awaitTermination(300)
    return plain(SR.read_reports(spark, str(tmp_path / "out")))


def test_stream_equals_batch(spark, devices, tmp_path):
    rule, model = str(tmp_path / "rule"), str(tmp_path / "model")
    SR.write_side(rule_rows(spark, RULE), rule, 0)
    SR.write_side(model_rows(spark, MODEL[:2]), model, 0)
    assert set(run(spark, devices, tmp_path)) == {1, 2}  # capture 3 waits for its model side
    SR.write_side(model_rows(spark, MODEL[2:] + [MODEL[0]]), model, 1)  # and a second delivery of capture 1
    got = run(spark, devices, tmp_path)
    assert got == plain(CR.compose(CR.pair(rule_rows(spark, RULE), model_rows(spark, MODEL)), devices))
    # capture 4 never gets a model side: time passes, in this stream by other captures
    SR.write_side(rule_rows(spark, [(4, 5, None, [])]), rule, 1)
    assert 4 not in run(spark, devices, tmp_path)
    SR.write_side(rule_rows(spark, [(6, 60, None, [])]), rule, 2)
    SR.write_side(model_rows(spark, [(6, 0, 60, None, [])]), model, 2)
    run(spark, devices, tmp_path)
    SR.write_side(rule_rows(spark, [(7, 120, None, [])]), rule, 3)
    got = run(spark, devices, tmp_path)
    assert json.loads(got[4]["result"]["message"]) == {"rb": "", "ml": CR.NO_MODEL_RESULT}
    assert got[6]["result"]["status"] == "success" and 7 not in got
    rows = SR.read_reports(spark, str(tmp_path / "out"))
    assert rows.count() == rows.select("capture_id").distinct().count() == 5


def test_repeated_batch_replaces_its_reports(spark, devices, tmp_path):
    pairs = rule_rows(spark, RULE[:1]).alias("r").join(model_rows(spark, MODEL[:1]).alias("m"), "capture_id").select(
        F.col("capture_id").alias("rule_capture"), F.col("capture_id").alias("model_capture"), "site_id", "rule_error", "rule_statistics", "alerts",
        "model_error", "model_statistics", "verdicts",
    )
    write = SR.report_batch(lambda: devices, str(tmp_path))
    for _ in range(2):
        write(pairs, 4)
    assert SR.read_reports(spark, str(tmp_path)).count() == 1

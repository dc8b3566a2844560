"""Streams give what the batch operators give."""

import datetime

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import alerts as A, features as FT, scoring, windows as W
from fluxwarden.plans import packet_queries as Q, synthetic
from fluxwarden.plans.fixtures import view
from fluxwarden.sources import files, stores
from fluxwarden.streaming import captures as SC, lookback

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def state_store(spark):
    lookback.use_state_store(spark)


def test_lookback_stream_equals_batch(spark, tmp_path):
    scores = view(spark, SF, "scores").withColumn("threshold", F.lit(0.1))
    expected = sorted(map(tuple, scoring.anomaly_flags(scores).select("device_mac", "score_seq", "is_anomaly").collect()))
    edges = [0, 200, 210, 600, 100_000]
    source = str(tmp_path / "scores")
    for low, high in zip(edges, edges[1:]):
        scores.filter((F.col("score_seq") >= low) & (F.col("score_seq") < high)).write.mode("append").parquet(source)
        query = (
            lookback.flag_stream(spark.readStream.schema(scores.schema).parquet(source))
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("device_mac", "score_seq", "is_anomaly").collect()))
    assert got == expected and any(r[2] for r in got)


def test_feature_stream_carries_over_captures(spark, tmp_path):
    packets = Q._registered(spark, SF)
    folder = tmp_path / "captures"
    folder.mkdir()
    import os
    import struct

    rows = synthetic.frames_of_packets(packets).orderBy("capture_id", "seq").collect()
    registry = view(spark, SF, "device_registry")
    for capture in (0, 1, 2):
        data = bytes.fromhex("A1B2C3D4") + bytes(20)
        for r in (r for r in rows if r.capture_id == capture):
            data += struct.pack(">IIII", r.ts_us // 1_000_000, r.ts_us % 1_000_000, len(r.frame), len(r.frame)) + bytes(r.frame)
        target = folder / f"{capture}.pcap"
        target.write_bytes(data)
        os.utime(target, (1_700_000_000 + capture * 100,) * 2)
        from fluxwarden.sources import captures as C

        SC.start_features(
            C.stream_files(spark, str(folder)), lambda: registry, str(tmp_path / "store"), str(tmp_path / "cp"), once=True
        ).awaitTermination(120)

    def result(df):
        return sorted(map(tuple, df.select("device_mac", "windowid", *[F.round(c, 9).alias(c) for c in FT.FEATURES]).collect()))

    assert result(SC.read_feature_log(spark, str(tmp_path / "store"))) == result(FT.window_features(packets))


def test_alert_stream_totals(spark, tmp_path):
    registry = view(spark, SF, "device_registry")
    rows = view(spark, SF, "alert_events")
    ether = F.when(F.col("has_ether"), F.struct("src_mac", "dest_mac"))
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    lines = rows.orderBy("seq").select(F.to_json(F.struct("event_type", stamp.alias("timestamp"), F.struct("signature").alias("alert"), ether.alias("ether"))).alias("value"), "seq")
    text = [r.value for r in lines.collect()]
    folder = tmp_path / "eve"
    folder.mkdir()
    half = len(text) // 2
    for i, part in enumerate((text[:half], text[half:])):
        (folder / f"{i}.json").write_text("\n".join(part) + "\n")
        SC.start_alerts(spark, str(folder), lambda: registry, str(tmp_path / "store"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    got = stores.newest_snapshot(spark, str(tmp_path / "store" / "alerts"))[1].drop("version")
    alerts = A.alert_device(A.only_alerts(rows.withColumn("macs", F.when(F.col("has_ether"), F.array("src_mac", "dest_mac")))), registry)
    key = lambda df: sorted((r.device_mac or "", r.signature, r.first_occurrence, r.number_occurrences) for r in df.collect())
    assert key(got) == key(A.alert_rollup(alerts))


def test_text_sources(spark, tmp_path):
    (tmp_path / "meta.json").write_text('{"AA:BB:CC:00:00:02": {"n": 1}, "AA:BB:CC:00:00:01": {}}')
    registry = files.read_device_registry(spark, str(tmp_path / "meta.json"))
    assert [(r.device_mac, r.position) for r in registry.orderBy("position").collect()] == [("aa-bb-cc-00-00-02", 0), ("aa-bb-cc-00-00-01", 1)]
    (tmp_path / "geo.csv").write_text('"0","16777215","-"\n"16777216","16777471","AU"\n')
    assert [r.country for r in files.geo_ranges(spark, str(tmp_path / "geo.csv")).orderBy("ip_start").collect()] == ["Unknown", "AU"]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"line {i}\n" for i in range(50)))
    (logs / "b.log").write_text("only\n")
    numbered = files.read_log_lines(spark, str(logs)).filter("file = 'a.log'").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in numbered] == [(i, f"line {i}") for i in range(50)]
    stamp = files.parse_alerts(spark.createDataFrame([('{"event_type":"alert","timestamp":"2024-01-02T03:04:05.000006+0000","alert":{"signature":"s"}}',)], "value string")).first()
    assert stamp.ts_us == int(datetime.datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=datetime.timezone.utc).timestamp() * 1e6 + 0.5)


def test_rules_with_buffers_and_bytes(spark):
    from fluxwarden.operators import rules as R

    lines = [
        'alert http $HOME_NET any -> any any (msg:"a"; http.request_line; content:"GET /x.php?"; http.user_agent; content:"Agent 1|3b| y"; sid:1; rev:1; metadata:affected_product Linux, signature_severity Major;)',
        'alert tcp $HOME_NET any -> $EXTERNAL_NET any (msg:"b"; content:"|0b 2f|t"; depth:3; sid:2; rev:1;)',
        '# alert udp any any -> any 123 (msg:"c"; content:"q"; sid:3;)',
        'alert udp any any -> any 123 (msg:"d"; content:"Z"; nocase; sid:4;)',
    ]
    rules = R.parse_rules(spark.createDataFrame([(x,) for x in lines], "line string"))
    first = rules.filter("rule_sid = 1").first()
    assert [(c.buffer, c.text) for c in first.contents] == [("http.request_line", "GET /x.php?"), ("http.user_agent", "Agent 1; y")]
    assert first.metadata == {"affected_product": "Linux", "signature_severity": "Major"}
    home, out = 3232235786, 16777216
    events = [
        (1, "http", home, out, 1, 80, {"http.request_line": "GET /x.php?a", "http.user_agent": "Agent 1; y"}),
        (2, "http", home, out, 1, 80, {"http.request_line": "Agent 1; y", "http.user_agent": "GET /x.php?a"}),
        (3, "tcp", home, out, 1, 80, {"payload": "\x0b/tail"}),
        (4, "tcp", home, out, 1, 80, {"payload": "x\x0b/tail"}),
        (5, "tcp", home, home, 1, 80, {"payload": "\x0b/tail"}),
        (6, "udp", out, home, 1, 123, {"payload": "z"}),
        (7, "udp", out, home, 1, 124, {"payload": "z"}),
    ]
    df = spark.createDataFrame(events, "event_id long, proto string, src_ip long, dst_ip long, event_src_port int, event_dst_port int, buffers map<string,string>")
    assert sorted(r.event_id for r in R.match_events(df, rules).collect()) == [1, 3, 6]
    assert {r.rule_sid: r.hits for r in R.rule_hits(df, rules).collect()} == {1: 1, 2: 1, 4: 1}

"""Rules against events: automaton and join give the same, and each part of a rule counts."""

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import rules as R

HOME, OUT = 3232235786, 16777216
EVENTS = "event_id long, proto string, src_ip long, dst_ip long, event_src_port int, event_dst_port int, buffers map<string,string>"


def parsed(spark, lines):
    return R.parse_rules(spark.createDataFrame([(x,) for x in lines], "line string"))


def rule(sid, options, header="tcp any any -> any any"):
    return f'alert {header} (msg:"m{sid}"; {options} sid:{sid}; rev:1;)'


def hits(events, rules):
    keyed = rules.select("rule_sid", *R.BODY).withColumn("body", R._body_key()).select("rule_sid", "body")
    return sorted((r.rule_sid, r.event_id) for r in R.match_events(events, rules).join(keyed, "body").select("rule_sid", "event_id").collect())


@pytest.fixture(params=["automaton", "join"])
def way(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(R, "MAX_PATTERNS", 0)


def test_contents(spark, way):
    rules = parsed(spark, [
        rule(1, 'content:"abc"; content:!"xyz";'), rule(2, 'content:!"abc";'), rule(3, 'content:"!abc";'), rule(4, 'content:"ABC"; nocase; content:"z"; depth:1;'),
        rule(5, 'http.cookie; content:"abc";'), rule(6, 'http.cookie; content:"q"; pkt_data; content:"abc";'), rule(7, 'content:"a|20|b";'),
        rule(8, 'content:"ÄÖ"; nocase;'), rule(9, 'content:"a";'),
    ])
    assert [(c.text, c.negate) for c in rules.filter("rule_sid = 1").first().contents] == [("abc", False), ("xyz", True)]
    rows = [(1, {"p": "abc"}), (2, {"p": "abc xyz"}), (3, {"p": "!abc"}), (4, {"p": "z aBc"}), (5, {"p": "abc", "http.cookie": "none"}),
            (6, {"p": "x", "http.cookie": "abc q"}), (7, {"p": "a b"}), (8, {"p": "äö"}), (9, {}), (10, None)]
    events = spark.createDataFrame([(i, "tcp", HOME, OUT, 1, 2, b) for i, b in rows], EVENTS)
    assert hits(events, rules) == sorted(
        [(1, 1), (1, 3), (1, 5), (1, 6), (3, 3), (4, 4), (5, 6), (6, 6), (7, 7), (8, 8)] + [(9, i) for i in (1, 2, 3, 4, 5, 6, 7)]
    )
    assert hits(events, parsed(spark, [rule(2, 'content:!"abc";')])) == []


def test_ports_and_directions(spark, way):
    specs = {1: "any", 2: "80", 3: "[80,443]", 4: "!80", 5: "1024:", 6: ":79", 7: "[80, 8000:9000]", 8: "![80,443]", 9: "[1:1000,!80]", 10: "$HTTP_PORTS"}
    rules = parsed(spark, [rule(i, 'content:"a";', f"tcp any any -> any {p}") for i, p in specs.items()] + [
        rule(20, 'content:"a";', "tcp $HOME_NET any -> $EXTERNAL_NET 80"), rule(21, 'content:"a";', "tcp $HOME_NET any <> $EXTERNAL_NET 80"),
    ])
    ports = [79, 80, 443, 1024, 8500]
    rows = [(p, "tcp", HOME, OUT, 5, p, {"p": "a"}) for p in ports] + [(1, "tcp", OUT, HOME, 80, 6, {"p": "a"}), (2, "udp", HOME, OUT, 5, 80, {"p": "a"})]
    found = hits(spark.createDataFrame(rows, EVENTS).filter("event_id > 10"), rules)
    got = {i: [e for s, e in found if s == i] for i in specs}
    assert got == {1: ports, 2: [80], 3: [80, 443], 4: [79, 443, 1024, 8500], 5: [1024, 8500], 6: [79], 7: [80, 8500], 8: [79, 1024, 8500], 9: [79, 443], 10: []}
    assert [s for s, e in hits(spark.createDataFrame(rows, EVENTS), rules) if e == 1 and s >= 20] == [21]
    assert [s for s, e in found if e == 80 and s >= 20] == [20, 21]


def test_few_candidates_and_shared_work(spark):
    rules = parsed(spark, [rule(i, f'content:"needle{i}"; content:"e";') for i in range(50)] + [rule(100 + i, 'content:"needle7";') for i in range(3)])
    events = spark.range(200).select(
        F.col("id").alias("event_id"), F.lit("tcp").alias("proto"), F.lit(1).cast("long").alias("src_ip"), F.lit(2).cast("long").alias("dst_ip"),
        F.lit(1).alias("event_src_port"), F.lit(2).alias("event_dst_port"), F.create_map(F.lit("p"), F.concat(F.lit("some text needle"), F.col("id"), F.lit(" "))).alias("buffers"),
    )
    assert R.candidates(events, R.rule_bodies(rules)).count() < 3 * 200
    counts = {r.rule_sid: r.hits for r in R.rule_hits(events, rules).collect()}
    assert counts[7] == counts[100] == counts[102] == 11 and counts[49] == 1


def test_rules_are_parsed_once_by_many_tasks(spark):
    lines = spark.createDataFrame([(rule(i, 'content:"a";'),) for i in range(50)], "line string").coalesce(1)
    rules = R.parse_rules(lines)
    assert rules.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    events = spark.createDataFrame([(1, "tcp", HOME, OUT, 1, 2, {"p": "a"})], EVENTS)
    found = R.rule_hits(events, rules)
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.rule_sid, r.msg, r.hits) for r in found.collect()) == [(i, f"m{i}", 1) for i in range(50)]

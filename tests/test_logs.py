"""Telemetry of three sources in one document, and logs packed for a report."""

import base64
import gzip
import json

from fluxwarden.operators import logs

GOOD = '{"sysstat":{"hosts":[{"statistics":[{"v":1}]}]}}'


def test_three_reports_in_one_document(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "iostat", GOOD), (1, 0, "pidstat", GOOD[: -len(logs.TELEMETRY_REPAIR)]), (1, 0, "sar", 'not "json"\nat all\n'),
            (2, 0, "iostat", "old"), (2, 1, "iostat", GOOD), (2, 0, "pidstat", ""), (2, 0, "sar", None), (2, 0, "other", "x"),
            (3, 0, "sar", "[1, 2]"), (4, 0, "other", GOOD), (None, 0, "sar", GOOD),
        ],
        "host int, seq int, source string, body string",
    )
    got = {r.host: r for r in logs.merge_telemetry(rows, ["host"]).collect()}
    assert set(got) == {1, 2, 3, None}  # host 4 has none of the three sources
    good = json.loads(GOOD)
    one = json.loads(got[1].monitor)
    assert list(one) == ["iostat", "pidstat", "sar"]
    assert one == {"iostat": good, "pidstat": good, "sar": ['not "json"\n', "at all\n"]}
    assert (got[1].iostat_state, got[1].pidstat_state, got[1].sar_state) == ("intact", "repaired", "raw")
    assert json.loads(got[2].monitor) == {"iostat": good, "pidstat": {}, "sar": {}}
    assert (got[2].iostat_state, got[2].pidstat_state) == ("intact", "empty")
    assert json.loads(got[3].monitor) == {"iostat": {}, "pidstat": {}, "sar": [1, 2]} and got[3].iostat_state == "missing"
    assert json.loads(got[None].monitor)["sar"] == good
    assert not logs.merge_telemetry(rows.limit(0), ["host"]).count()


def test_a_bundle_unpacks_to_the_tails(spark):
    lines = [(site, f"{site}.log", i, f"line {i} \u00e4 \"") for site in ("a", "b") for i in range(9)] + [("a", "z.log", 0, ""), ("c", None, 0, "x"), ("d", "f", 0, None)]
    rows = spark.createDataFrame(lines, "site string, file string, line_no long, line string")
    tails = logs.log_tail(rows.filter("file is not null"), 3)
    for packed in (logs.error_bundle(tails, ["site"], "v9"), logs.error_bundle(rows.limit(0), ["site"], "v9")):
        got = {r.site: json.loads(gzip.decompress(base64.b64decode(r.error_logs["v9"]))) for r in packed.collect()}
        if got:
            text = "\n".join(f"line {i} \u00e4 \"" for i in (6, 7, 8))
            assert got == {"a": {"a.log": text, "z.log": ""}, "b": {"b.log": text}}
    whole = logs.error_bundle(rows, ["site"], "v9").collect()
    assert {r.site for r in whole} == {"a", "b"} and len(json.loads(min(whole, key=lambda r: r.site).document)["a.log"].split("\n")) == 9


def test_documents_are_packed_a_few_at_a_time(spark):
    """No Arrow batch of ten thousand documents: rows pass through Python a hundred at a time."""
    rows = spark.createDataFrame([(1, "a", 0, "x")], "site int, file string, line_no long, line string")
    plan = logs.error_bundle(rows, ["site"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan

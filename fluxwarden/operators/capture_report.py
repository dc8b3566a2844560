"""The report of a capture, joined from the results of two analyses.

Each analysis gives one row per capture, a side:

* rule side ``(capture_id, rule_error, rule_statistics, alerts)``, alerts: ``(device_mac, suricata)`` structs;
* model side ``(capture_id, model_error, model_statistics, verdicts)``, verdicts: ``(device_mac, ml)`` structs.

A report needs both. A side that is missing counts as an error of that side. A capture with any error gets a head
with the messages of both sides and nothing else; every other capture gets the merged statistics and one detection
for each registered device of its site, in registry order.

The sides are stored as they are by a stream (``streaming.reports``), which joins them with the functions below, so
batch and stream give the same reports. A side holds the devices of one capture, never more; reports of different
captures never meet, so they spread over as many tasks as there are captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from . import alerts as A
from .report import merge_statistics, report_head

DEVICE = ("capture_id", "device_mac")
NO_RULE_RESULT = "No result of the rule analysis"
NO_MODEL_RESULT = "No result of the model analysis"

ML = "struct<type:string,description:string,score:double>"
VERDICTS = f"array<struct<device_mac:string,ml:{ML}>>"
ALERTS = (
    "array<struct<device_mac:string,suricata:array<struct<type:string,description:string,first_occurrence:bigint,"
    "number_occurrences:bigint,score:int>>>>"
)


def _listed(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """One list per capture, in order of the devices."""
    return rows.groupBy("capture_id").agg(F.sort_array(F.collect_list(value)).alias(column))


def _or_empty(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column).cast(kind), F.array().cast(kind)).alias(column)


def rule_side(runs: DataFrame, rollup: DataFrame) -> DataFrame:
    """``runs``: ``capture_id, rule_error, rule_statistics`` (map of texts); ``rollup``: alerts rolled up by DEVICE."""
    entries = A.as_report_entries(rollup.filter("device_mac is not null"), DEVICE)
    lists = _listed(entries, "alerts", F.struct("device_mac", "suricata"))
    return runs.join(lists, "capture_id", "left").select("capture_id", "rule_error", "rule_statistics", _or_empty("alerts", ALERTS))


def device_statistics(captures: DataFrame, devices: DataFrame, traffic: DataFrame) -> DataFrame:
    """``(capture_id, devices)``: volume and external addresses of every registered device, also of silent ones."""
    stats = F.struct("country", "data_volume_bytes", "packet_count")
    seen = traffic.groupBy(*DEVICE).agg(
        F.sum("packet_count").alias("packets"), F.sum("data_volume_bytes").alias("volume"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(S.ip_text(F.col("remote_ip")).alias("ip"), stats.alias("stats"))))).alias("external"),
    )
    rows = captures.select("capture_id", "site_id").join(devices.select("site_id", "device_mac", "position").distinct(), "site_id")
    zero = F.lit(0).cast("long")
    volume = F.struct(F.coalesce("packets", zero).alias("packet_count"), F.coalesce("volume", zero).alias("data_volume_bytes"))
    entry = F.struct(S.mac_display(F.col("device_mac")).alias("mac"), "external", volume.alias("data_volume"))
    both = rows.join(seen, list(DEVICE), "left").withColumn("external", F.coalesce("external", F.create_map().cast(seen.schema["external"].dataType)))
    ordered = both.groupBy("capture_id").agg(F.collect_list(F.struct("position", "device_mac", F.to_json(entry).alias("entry"))).alias("l"))
    # the entries hold maps, which cannot be sorted: their places are, and the texts follow
    return ordered.select("capture_id", F.concat(F.lit("["), F.array_join(F.transform(F.sort_array("l"), lambda x: x["entry"]), ","), F.lit("]")).alias("devices"))


def model_side(captures: DataFrame, devices: DataFrame, totals: DataFrame, traffic: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``captures``: ``capture_id, site_id``; ``devices``: ``site_id, device_mac, position``; ``totals`` and ``traffic`` by
    capture; ``verdicts`` by DEVICE."""
    ml = F.struct("type", "description", F.col("score").cast("double").alias("score"))
    lists = _listed(verdicts, "verdicts", F.struct("device_mac", ml.alias("ml")))
    known = captures.select("capture_id").join(totals, "capture_id", "left")
    statistics = F.create_map(
        F.lit("totalBytes"), F.coalesce("total_bytes", F.lit(0)).cast("string"), F.lit("packets"), F.coalesce("packets", F.lit(0)).cast("string"),
        F.lit("devices"), F.coalesce("devices", F.lit("[]")),
    )
    return (
        known.join(device_statistics(captures, devices, traffic), "capture_id", "left")
        .join(lists, "capture_id", "left")
        .select("capture_id", F.col("error").alias("model_error"), statistics.alias("model_statistics"), _or_empty("verdicts", VERDICTS))
    )


def pair(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Both sides of every capture."""
    sides = rule.withColumn("_rule", F.lit(True)).join(model.withColumn("_model", F.lit(True)), "capture_id", "full_outer")
    return complete(sides, F.col("_rule").isNotNull(), F.col("_model").isNotNull()).drop("_rule", "_model")


def complete(sides: DataFrame, has_rule: Column, has_model: Column) -> DataFrame:
    """Joined sides with an error for each that is missing."""
    return sides.withColumns(
        {
            "rule_error": F.when(has_rule, F.col("rule_error")).otherwise(NO_RULE_RESULT),
            "model_error": F.when(has_model, F.col("model_error")).otherwise(NO_MODEL_RESULT),
        }
    )


def compose(pairs: DataFrame, devices: DataFrame) -> DataFrame:
    """``(capture_id, result, statistics, detections)`` from ``pairs`` with their ``site_id``."""
    headed = report_head(pairs)
    good = headed.filter("result.status = 'success'")
    rows = good.select("capture_id", "site_id").join(devices.select("site_id", "device_mac", "position").distinct(), "site_id")
    alerts = good.select("capture_id", F.explode("alerts").alias("a")).select("capture_id", "a.device_mac", "a.suricata")
    verdicts = good.select("capture_id", F.explode("verdicts").alias("v")).select("capture_id", "v.device_mac", "v.ml")
    none = F.struct(F.lit("Normal").alias("type"), F.lit("No data").alias("description"), F.lit(0.0).alias("score"))
    entry = F.struct(
        "position", "device_mac",
        F.struct(
            S.mac_display(F.col("device_mac")).alias("mac"),
            F.coalesce("suricata", F.array().cast(alerts.schema["suricata"].dataType)).alias("suricata"),
            F.coalesce("ml", none).alias("ml"),
        ).alias("detection"),
    )
    found = rows.join(alerts, list(DEVICE), "left").join(verdicts, list(DEVICE), "left").groupBy("capture_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["detection"]).alias("detections")
    )
    ok = F.col("result.status") == "success"
    return headed.join(found, "capture_id", "left").select(
        "capture_id", "result",
        F.when(ok, merge_statistics(F.col("rule_statistics"), F.col("model_statistics"))).alias("statistics"),
        F.when(ok, F.coalesce("detections", F.array().cast(found.schema["detections"].dataType))).alias("detections"),
    )


def as_document(reports: DataFrame) -> DataFrame:
    """``(capture_id, report)``: the JSON document; a head only where an analysis failed."""
    return reports.select("capture_id", F.to_json(F.struct(F.col("capture_id").alias("file"), "result", "statistics", "detections")).alias("report"))

"""Alert events: device attribution and roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import ordered


def only_alerts(events: DataFrame) -> DataFrame:
    """Alert events that carry MAC addresses."""
    return events.filter("event_type = 'alert' and macs is not null")


def alert_device(alerts: DataFrame, registry: DataFrame) -> DataFrame:
    """Device of each alert: the first registry entry among its MACs, else null.

    ``alerts``: ``seq`` (unique) and ``macs`` (colon form); ``registry``:
    ``device_mac, position``. An alert's other columns travel along, so it
    meets its device again without a join.
    """
    entries = registry.select(
        F.translate(F.lower("device_mac"), "-", ":").alias("_mac"), F.col("device_mac"), "position"
    )
    exploded = alerts.select("seq", F.struct(*alerts.columns).alias("_alert"), F.explode_outer("macs").alias("_mac"))
    matched = exploded.join(entries, "_mac", "left")
    first = matched.groupBy("seq").agg(F.first("_alert").alias("_alert"), F.min_by("device_mac", "position").alias("device_mac"))
    return first.select("_alert.*", "device_mac")


def alert_rollup(alerts: DataFrame, keys: tuple[str, ...] = ("device_mac",)) -> DataFrame:
    """Occurrences and first time, in arrival order, per device (or other keys) and signature."""
    return alerts.groupBy(*keys, "signature").agg(
        F.min_by("ts_us", "seq").alias("first_occurrence"), F.count(F.lit(1)).alias("number_occurrences")
    )


def alert_rollup_compat(alerts: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Roll-up as older reports had it: only the first signature of a device is
    counted, every other alert stays a row of its own."""
    keys = F.coalesce("device_mac", F.lit(""))  # alerts without device form a group, too
    rows = ordered.with_block(alerts.withColumn("_device", keys), "seq", bits)
    first = rows.groupBy("_device").agg(
        F.min_by("signature", "seq").alias("_signature"), F.min("seq").alias("_seq")
    )
    marked = ordered.attach(rows, first, ["_device"])
    is_first = F.col("signature") == F.col("_signature")
    counted = marked.filter(is_first).groupBy("device_mac", "signature").agg(
        F.min("seq").alias("seq"), F.min_by("ts_us", "seq").alias("first_occurrence"),
        F.count(F.lit(1)).alias("number_occurrences"),
    )
    single = marked.filter(~is_first).select(
        "device_mac", "signature", "seq", F.col("ts_us").alias("first_occurrence"),
        F.lit(1).cast("long").alias("number_occurrences"),
    )
    return counted.unionByName(single)


def as_report_entries(rollup: DataFrame, keys: tuple[str, ...] = ("device_mac",)) -> DataFrame:
    """Alert structs of a device in report form."""
    entry = F.struct(
        F.lit("Alert").alias("type"),
        F.col("signature").alias("description"),
        F.col("first_occurrence"),
        F.col("number_occurrences"),
        F.lit(100).alias("score"),
    )
    return rollup.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("suricata"))

"""Traffic statistics per capture, device and external address."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .geo import with_country
from .packets import FAULTS

MIN_SPAN_US = 60_000_000


def external_ip_traffic(packets: DataFrame, ranges: DataFrame, keys: list[str] = ["device_mac"]) -> DataFrame:
    """Packets and bytes per device and external address, with its country.

    Aggregates first; only the distinct (device, address) pairs are looked up.
    """
    pairs = packets.groupBy(*keys, "remote_ip").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("data_volume_bytes")
    )
    return with_country(pairs, ranges)


def device_traffic(packets: DataFrame, registry: DataFrame) -> DataFrame:
    """Packets and bytes per registered device, zero where a device was silent."""
    seen = packets.groupBy("device_mac").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("data_volume_bytes")
    )
    zero = F.lit(0).cast("long")
    return (
        registry.select("device_mac")
        .distinct()
        .join(seen, "device_mac", "left")
        .select(
            "device_mac",
            F.coalesce("packet_count", zero).alias("packet_count"),
            F.coalesce("data_volume_bytes", zero).alias("data_volume_bytes"),
        )
    )


# Error texts of a capture without any usable packet.
NO_VALID_PACKETS = "Pcap read in successfuly, but no valid packets found in pcap. {} errors occurred."
NO_PACKETS = "Pcap read in successfuly, but 0 packets found in pcap."


def capture_totals(labelled: DataFrame, captures: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Valid packets and bytes, faults and the resulting status per capture.

    ``captures`` lists the capture ids, so that one without any frame still
    gets its row and its error. ``failures`` (capture_id, read_error) has the
    reader's errors, which stand before all others.
    """
    ok = F.col("disposition") == "accepted"
    totals = labelled.groupBy("capture_id").agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("packets"),
        F.sum(F.when(ok, F.col("frame_len").cast("long")).otherwise(0)).alias("total_bytes"),
        F.sum(F.when(F.col("disposition").isin(FAULTS), 1).otherwise(0)).alias("faults"),
        F.count(F.lit(1)).alias("frames"),
    )
    if captures is not None:
        totals = captures.select("capture_id").join(totals, "capture_id", "left").na.fill(0)
    head, tail = NO_VALID_PACKETS.split("{}")
    error = (
        F.when(F.col("packets") > 0, F.lit(None).cast("string"))
        .when(F.col("faults") > 0, F.concat(F.lit(head), F.col("faults").cast("string"), F.lit(tail)))
        .otherwise(F.lit(NO_PACKETS))
    )
    ratio = F.coalesce(F.try_divide(F.col("faults"), F.col("frames")), F.lit(0.0))
    totals = totals.withColumn("fault_ratio", ratio).withColumn("error", error)
    if failures is None:
        return totals
    return totals.join(failures, "capture_id", "left").withColumn("error", F.coalesce("read_error", "error")).drop("read_error")


def disposition_counts(labelled: DataFrame, pivot: bool = False) -> DataFrame:
    if pivot:
        return labelled.groupBy("capture_id").pivot("disposition", ["accepted", *FAULTS, "unknown_device"]).count().na.fill(0)
    return labelled.groupBy("capture_id", "disposition").agg(F.count(F.lit(1)).alias("frames"))


def enough_packets(packets: DataFrame) -> DataFrame:
    """Time span per capture and device and whether it can fill one window."""
    span = packets.groupBy("capture_id", "device_mac").agg(
        F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"), F.count(F.lit(1)).alias("packets")
    )
    return span.withColumn("enough", F.col("last_ts") - F.col("first_ts") > MIN_SPAN_US)


def nested_traffic(traffic: DataFrame, bucket: int | None = None, registry: DataFrame | None = None) -> DataFrame:
    """External traffic of a device as a map address -> statistics.

    The report format asks for one map per device. Its size is the number of
    distinct remote addresses, after aggregation. A device that talks to very
    many addresses can be split over ``bucket`` report rows. Devices of
    ``registry`` without traffic get an empty map.
    """
    entry = F.struct(
        F.col("remote_ip").alias("ip"),
        F.struct("country", "data_volume_bytes", "packet_count").alias("stats"),
    )
    keys = ["device_mac"] if bucket is None else ["device_mac", "part"]
    rows = traffic if bucket is None else traffic.withColumn("part", F.pmod(F.xxhash64("remote_ip"), F.lit(bucket)))
    nested = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("external_ips"))
    if registry is None:
        return nested
    silent = registry.select("device_mac").distinct().join(nested, "device_mac", "left_anti")
    empty = F.create_map().cast(nested.schema["external_ips"].dataType)
    return nested.unionByName(silent.withColumn("external_ips", empty), allowMissingColumns=True)

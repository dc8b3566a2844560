"""Continuous capture and alert processing in micro-batches.

Windows never span captures, so a micro-batch runs the batch operators. What
crosses captures is the last row of each device, kept as a snapshot per batch
id: a repeated batch reads the snapshot before it and writes the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import alerts as A, features as FT
from ..plans.pipeline import read_packets
from ..session import cut_lineage
from ..sources import files, stores


def feature_batch(spark: SparkSession, registry: Callable[[], DataFrame], root: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        found = stores.newest_snapshot(spark, f"{root}/carry", before=batch_id)
        carry = found[1] if found else spark.createDataFrame([], FT.CARRY_SCHEMA)
        packets, _ = read_packets(batch, registry())
        features = cut_lineage(FT.window_features(packets, carry=carry))
        stores.write_snapshot(features.select("capture_id", "device_mac", "windowid", *FT.FEATURES), f"{root}/features", batch_id)
        stores.write_snapshot(stores.upsert(carry, FT.next_carry(features), ["device_mac"]), f"{root}/carry", batch_id)

    return run


def start_features(
    captures: DataFrame, registry: Callable[[], DataFrame], root: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Feature rows of every new capture under ``root/features``.

    ``registry`` is called per micro-batch, so devices can come and go.
    """
    writer = captures.writeStream.foreachBatch(feature_batch(captures.sparkSession, registry, root)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_feature_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/features").drop("version")


def alert_batch(spark: SparkSession, registry: Callable[[], DataFrame], root: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        # Line ids restart per batch; earlier totals win the first occurrence.
        lines = batch.select("value", F.monotonically_increasing_id().alias("seq"))
        new = A.alert_rollup(A.alert_device(A.only_alerts(files.parse_alerts(lines)), registry()))
        found = stores.newest_snapshot(spark, f"{root}/alerts", before=batch_id)
        totals = new.withColumn("_age", F.lit(1))
        if found:
            totals = totals.unionByName(found[1].drop("version").withColumn("_age", F.lit(0)))
        merged = totals.groupBy("device_mac", "signature").agg(
            F.min_by("first_occurrence", "_age").alias("first_occurrence"),
            F.sum("number_occurrences").alias("number_occurrences"),
        )
        stores.write_snapshot(merged, f"{root}/alerts", batch_id)

    return run


def start_alerts(
    spark: SparkSession, path: str, registry: Callable[[], DataFrame], root: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Alert totals per device and signature; rows already read are remembered by
    the stream, so the source files need not be emptied."""
    lines = spark.readStream.schema("value string").text(path)
    writer = lines.writeStream.foreachBatch(alert_batch(spark, registry, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

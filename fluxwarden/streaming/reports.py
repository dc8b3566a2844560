"""Reports of captures from two streams of results.

Each analysis writes its side of a capture (``operators.capture_report``) to a folder, with the time of its arrival. The
report stream joins both folders on the capture: the join's state holds a side until the other one comes, or until
the watermark has passed it by ``timeout``; then the side leaves alone and the report is an error head that names
what is missing. A side delivered twice within the timeout counts once.

The watermark is that of the faster stream (``use_fast_watermark``): one analysis that stands still must not hold back
the error heads of its captures. A side that arrives after its capture has timed out is dropped by the join.

Reports are written by batch number, so a repeated batch replaces its own reports and adds none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import capture_report as CR
from ..sources import stores

RULE_SIDE = f"capture_id {{kind}}, arrived timestamp, rule_error string, rule_statistics map<string,string>, alerts {CR.ALERTS}"
MODEL_SIDE = f"capture_id {{kind}}, site_id bigint, arrived timestamp, model_error string, model_statistics map<string,string>, verdicts {CR.VERDICTS}"


def use_fast_watermark(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")


def write_side(side: DataFrame, root: str, batch_id: int) -> None:
    """One batch of a side; a repeated batch replaces its files."""
    stores.write_snapshot(side, root, batch_id)


def read_sides(spark: SparkSession, root: str, schema: str, id_type: str = "bigint") -> DataFrame:
    """New rows of a side as a stream."""
    return spark.readStream.schema(schema.format(kind=id_type)).option("recursiveFileLookup", "true").parquet(root)


def joined_sides(rule: DataFrame, model: DataFrame, timeout: str) -> DataFrame:
    """Streams of both sides to pairs; either may be missing."""
    def once(side: DataFrame) -> DataFrame:
        return side.withWatermark("arrived", timeout).dropDuplicatesWithinWatermark(["capture_id"])

    wait = f"interval {timeout}"
    r = once(rule).select(F.col("capture_id").alias("rule_capture"), F.col("arrived").alias("rule_arrived"), "rule_error", "rule_statistics", "alerts")
    m = once(model).select(F.col("capture_id").alias("model_capture"), F.col("arrived").alias("model_arrived"), "site_id", "model_error", "model_statistics", "verdicts")
    near = F.expr(f"rule_capture = model_capture and model_arrived between rule_arrived - {wait} and rule_arrived + {wait}")
    return r.join(m, near, "full_outer")


def report_batch(devices: Callable[[], DataFrame], root: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        sides = CR.complete(batch, F.col("rule_capture").isNotNull(), F.col("model_capture").isNotNull())
        pairs = sides.withColumn("capture_id", F.coalesce("rule_capture", "model_capture"))
        stores.write_snapshot(CR.compose(pairs, devices()), f"{root}/reports", batch_id)

    return run


def start_reports(
    rule: DataFrame, model: DataFrame, devices: Callable[[], DataFrame], root: str, checkpoint: str, timeout: str = "10 minutes", once: bool = False
) -> StreamingQuery:
    """Reports of captures under ``root/reports``. ``devices`` is called per micro-batch: ``site_id, device_mac, position``."""
    use_fast_watermark(rule.sparkSession)
    writer = joined_sides(rule, model, timeout).writeStream.foreachBatch(report_batch(devices, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/reports").drop("version")

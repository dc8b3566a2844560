"""Features of a micro-batch to where their devices' actions send them.

A device collects data, is judged, or waits for its training. One batch of feature rows is fanned out to the dataset, the
scores and the training queue, and the training status of collecting devices moves on. Every sink is written by batch
number, and the status a batch starts from is the newest one before it, so a repeated batch writes the same again.

Scores of a device are flagged with the scores of its earlier batches in front (``scoring.anomaly_flags`` needs the
last 15): the tail is kept per batch like the status, for the devices of the batch and the others alike. A batch whose
scoring fails leaves the tail as it was; a device that has been trained starts from the tail of its training scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import features as FT, models as M, scoring as SC, training as TR
from ..plans.pipeline import Registry
from ..session import cut_lineage
from ..sources import stores

STATUS = ["device_mac", "current_size", "distinct_hour_buckets", "distinct_day_buckets", "progress", "description"]
TAIL = "device_mac string, score_seq long, score double"


def activity(features: DataFrame) -> DataFrame:
    """Windows by device and by hour and day of their beginning."""
    seconds = F.col("windowid") / 1_000_000
    return features.groupBy("device_mac", F.floor(seconds / 3600).alias("hour_bucket"), F.floor(seconds / 86_400).alias("day_bucket")).agg(
        F.count(F.lit(1)).alias("windows")
    )


def _before(spark: SparkSession, root: str, batch_id: int, otherwise: DataFrame) -> DataFrame:
    found = stores.newest_snapshot(spark, root, before=batch_id)
    return found[1].drop("version") if found else otherwise


def flagged(features: DataFrame, tail: DataFrame, registry: Registry) -> DataFrame:
    """Flags of new windows, with the earlier scores of their devices in front."""
    vectors = FT.feature_vector(features).select("capture_id", "device_mac", F.col("windowid").alias("vec_seq"), "vector")
    new = M.score_windows(vectors, registry.models, bits=36, tags=("capture_id",)).withColumnRenamed("vec_seq", "score_seq")
    old = tail.join(features.select("device_mac").distinct(), "device_mac", "left_semi")
    history = new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    limited = history.join(registry.thresholds.select("device_mac", "threshold"), "device_mac", "left")
    return SC.anomaly_flags(limited, bits=36).filter("_new").drop("_new")


def route_batch(spark: SparkSession, registry: Callable[[], Registry], root: str, training_enabled: bool = True) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        known = registry()
        status = _before(spark, f"{root}/status", batch_id, known.status.select(*STATUS))
        tail = _before(spark, f"{root}/tail", batch_id, spark.createDataFrame([], TAIL))
        action = TR.decide_action(F.col("progress"), training_enabled)
        acted = cut_lineage(batch.join(status.select("device_mac", "progress"), "device_mac").withColumn("action", action).drop("progress"))

        collected = acted.filter(F.col("action") == TR.COLLECT).drop("action")
        stores.write_snapshot(collected, f"{root}/dataset", batch_id)
        grown = TR.merge_status(
            status.join(collected.select("device_mac").distinct(), "device_mac", "left_semi"), TR.evaluate_status(activity(collected))
        ).select(*STATUS)
        after = cut_lineage(stores.upsert(status, grown, ["device_mac"]))
        stores.write_snapshot(after, f"{root}/status", batch_id)

        waiting = acted.filter(F.col("action") == TR.TRAIN).select("device_mac").distinct()
        complete = grown.filter((F.col("progress") >= TR.COLLECTED) & (F.col("progress") < 1.0)).select("device_mac")
        stores.write_snapshot(waiting.unionByName(complete).distinct(), f"{root}/training", batch_id)

        flags = cut_lineage(flagged(acted.filter(F.col("action") == TR.INFER).drop("action"), tail, known))
        stores.write_snapshot(flags, f"{root}/scores", batch_id)
        scored = tail.unionByName(flags.filter("score is not null").select("device_mac", "score_seq", "score"))
        stores.write_snapshot(SC.score_tail(scored, bits=36), f"{root}/tail", batch_id)

    return run


def start_routing(
    features: DataFrame, registry: Callable[[], Registry], root: str, checkpoint: str, training_enabled: bool = True, once: bool = False
) -> StreamingQuery:
    """Routes a stream of feature rows (capture_id, device_mac, windowid, FEATURES); ``registry`` is read per batch."""
    run = route_batch(features.sparkSession, registry, root, training_enabled)
    writer = features.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_sink(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All batches of the dataset, the scores or the training queue."""
    return spark.read.parquet(f"{root}/{name}")

"""Rules over a stream of events, refreshed between micro-batches.

Rule text is published in numbered versions. A batch takes the newest version there is when it first runs and notes it, so
a repeated batch meets the same rules; a rule that was published between two batches fires from the second one on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import rules as RU
from ..sources import stores


def publish_rules(lines: DataFrame, root: str, version: int) -> None:
    """Rule lines (``line``) as a version; those of lower numbers stay for batches that noted them."""
    stores.write_snapshot(lines.select("line"), root, version)


def noted_version(spark: SparkSession, rules_root: str, root: str, batch_id: int) -> int | None:
    """The version of rules of a batch: noted before, or the newest, which is noted now."""
    noted = stores.newest_snapshot(spark, f"{root}/used", before=batch_id + 1)
    if noted and noted[0] == batch_id:
        return noted[1].first()["rules_version"]
    newest = stores.newest_snapshot(spark, rules_root)
    if newest is None:
        return None
    stores.write_snapshot(spark.createDataFrame([(newest[0],)], "rules_version long"), f"{root}/used", batch_id)
    return newest[0]


def rule_batch(spark: SparkSession, rules_root: str, root: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        version = noted_version(spark, rules_root, root, batch_id)
        if version is None:
            return
        lines = stores.newest_snapshot(spark, rules_root, before=version + 1)[1].select("line")
        hits = RU.rule_hits(batch, RU.parse_rules(lines)).withColumn("rules_version", F.lit(version).cast("long"))
        stores.write_snapshot(hits, f"{root}/hits", batch_id)

    return run


def start_rules(events: DataFrame, rules_root: str, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hits per rule and batch of a stream of events under ``root/hits``."""
    writer = events.writeStream.foreachBatch(rule_batch(events.sparkSession, rules_root, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

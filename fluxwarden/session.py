"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fluxwarden", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by the tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Percentiles per window: stay in hash aggregation beyond the default 128 groups.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of every column expression cost more time than planning a query of hundreds of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder. Where none is set, a local session gets a
    temporary folder, as in tests; a cluster must name one, as its machines do not share theirs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="fluxwarden-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    It is computed once, survives the loss of an executor, and readers still
    prune columns and know its size. The folder follows the clean-up rules of
    the cluster's checkpoint folder.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

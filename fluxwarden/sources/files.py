"""Text, CSV and JSON inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators.geo import UNKNOWN
from ..operators.logs import numbered_lines

ALERT_SCHEMA = (
    "event_type string, timestamp string, alert struct<signature:string, signature_id:long, severity:int>, "
    "ether map<string,string>"
)


def geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Address ranges from a header-less CSV; names with a dash become Unknown."""
    rows = spark.read.schema("ip_start long, ip_end long, country string").csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return clean_countries(rows)


def clean_countries(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn(
        "country", F.when(F.col("country").contains("-"), UNKNOWN).otherwise(F.trim("country"))
    )


def registry_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def device_registry(documents: DataFrame, column: str = "value") -> DataFrame:
    """Devices of a JSON object in file order; only the keys matter."""
    keys = documents.select(F.posexplode(F.map_keys(registry_from_json(F.col(column)))).alias("position", "mac"))
    return keys.select(S.mac_key(F.col("mac")).alias("device_mac"), F.col("position").cast("long").alias("position"))


def read_device_registry(spark: SparkSession, path: str) -> DataFrame:
    return device_registry(spark.read.text(path, wholetext=True))


def parse_alerts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alert JSON lines to flat rows; all MACs of ``ether`` in one array."""
    parsed = lines.withColumn("_e", F.from_json(column, ALERT_SCHEMA))
    others = [c for c in lines.columns if c != column]
    return parsed.select(
        *others,
        F.col("_e.event_type").alias("event_type"),
        F.unix_micros(F.to_timestamp("_e.timestamp")).alias("ts_us"),
        F.col("_e.timestamp").alias("timestamp"),
        F.col("_e.alert.signature").alias("signature"),
        F.transform(F.map_values("_e.ether"), F.lower).alias("macs"),
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert files; the events are ordered by the age of their file and the position in it, not by the order in which
    Spark happens to read files and splits."""
    seq = F.struct(
        F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"),
    )
    return parse_alerts(spark.read.text(path).select("value", seq.alias("seq")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of all log files of a folder."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    return numbered_lines(raw)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry documents, one per file; each is a few hundred kilobytes."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("body")
    )

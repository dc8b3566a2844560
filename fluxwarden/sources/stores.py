"""Tables that outlive a run: features, status, thresholds, models, reports.

Parquet has no in-place update. Upserts write a new snapshot folder next to the
old ones; readers take the newest complete one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

FEATURE_BUCKETS = 256
STATUS_SCHEMA = (
    "struct<current_size:bigint,distinct_hour_buckets:array<bigint>,distinct_day_buckets:array<bigint>,"
    "progress:double,description:string>"
)


def device_bucket(key: str = "device_mac", buckets: int = FEATURE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append_features(features: DataFrame, path: str, key: str = "device_mac", buckets: int = FEATURE_BUCKETS) -> None:
    """Append feature rows, partitioned by device bucket.

    Rows are first brought together by bucket and a slice number, so a bucket
    gets a handful of files, and more where it holds more.
    """
    slices = F.pmod(F.xxhash64(*[c for c in features.columns if c != key][:2]), F.lit(8))
    (
        features.withColumn("device_bucket", device_bucket(key, buckets))
        .withColumn("_slice", slices)
        .repartition("device_bucket", "_slice")
        .drop("_slice")
        .write.mode("append")
        .partitionBy("device_bucket")
        .parquet(path)
    )


def load_features(spark: SparkSession, path: str, devices: DataFrame | None = None, key: str = "device_mac", buckets: int = FEATURE_BUCKETS) -> DataFrame:
    """Stored features, optionally of some devices. Their buckets, at most ``buckets`` numbers, become a filter on
    the partition column, so that the other folders are not read."""
    rows = spark.read.parquet(path)
    if devices is None:
        return rows.drop("device_bucket")
    wanted = devices.select(key).distinct().withColumn("device_bucket", device_bucket(key, buckets))
    held = [r[0] for r in wanted.select("device_bucket").distinct().collect()]
    return rows.filter(F.col("device_bucket").isin(held)).join(wanted, ["device_bucket", key]).drop("device_bucket")


def clear_features(spark: SparkSession, path: str, devices: DataFrame, key: str = "device_mac", buckets: int = FEATURE_BUCKETS) -> None:
    """Take the given devices out of the store. Only the buckets of these devices, at most ``buckets`` numbers, are read
    and written again; the files of all others stay as they are."""
    wanted = devices.select(key).distinct().withColumn("device_bucket", device_bucket(key, buckets))
    held = [r[0] for r in wanted.select("device_bucket").distinct().collect()]
    kept = spark.read.parquet(path).filter(F.col("device_bucket").isin(held)).join(wanted, ["device_bucket", key], "left_anti")
    kept = cut_lineage(kept)  # the folders read are the folders written
    left = {r[0] for r in kept.select("device_bucket").distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("device_bucket").parquet(path)
    jvm = spark.sparkContext._jvm
    for bucket in set(held) - left:  # nothing was written for these
        folder = jvm.org.apache.hadoop.fs.Path(path, f"device_bucket={bucket}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old rows whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    target = f"{root}/version={version:012d}"
    df.write.mode("overwrite").parquet(target)
    return target


def newest_snapshot(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, DataFrame] | None:
    """Version and rows of the newest finished snapshot, optionally below a version."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [
        s.getPath() for s in fs.listStatus(folder)
        if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    versions = {int(p.getName().split("=")[1]): p.toString() for p in done}
    usable = [v for v in versions if before is None or v < before]
    if not usable:
        return None
    return max(usable), spark.read.parquet(versions[max(usable)])


def status_to_json(status: DataFrame) -> DataFrame:
    fields = ["current_size", "distinct_hour_buckets", "distinct_day_buckets", "progress", "description"]
    return status.select("device_mac", F.to_json(F.struct(*fields)).alias("status"))


def status_from_json(rows: DataFrame) -> DataFrame:
    """Missing fields take the values of an empty status."""
    parsed = rows.select("device_mac", F.from_json("status", STATUS_SCHEMA[len("struct<"):-1].replace(":", " ")).alias("s"))
    none = F.array().cast("array<bigint>")
    return parsed.select(
        "device_mac",
        F.coalesce("s.current_size", F.lit(0)).alias("current_size"),
        F.sort_array(F.array_distinct(F.coalesce("s.distinct_hour_buckets", none))).alias("distinct_hour_buckets"),
        F.sort_array(F.array_distinct(F.coalesce("s.distinct_day_buckets", none))).alias("distinct_day_buckets"),
        F.coalesce("s.progress", F.lit(0.0)).alias("progress"),
        F.coalesce("s.description", F.lit("Data collection ongoing")).alias("description"),
    )


def migrate_thresholds(rows: DataFrame, column: str = "value") -> DataFrame:
    """Threshold JSON per device: objects keep their version, bare numbers get "0"."""
    v = F.try_parse_json(column)
    threshold = F.coalesce(F.try_variant_get(v, "$.threshold", "double"), F.try_variant_get(v, "$", "double"))
    version = F.coalesce(F.try_variant_get(v, "$.version", "string"), F.lit("0"))
    return rows.select("device_mac", threshold.alias("threshold"), version.alias("version"))


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("errorifexists").parquet(path)


def load_models(spark: SparkSession, path: str, parameters: int | None = None) -> DataFrame:
    """Stored models; a row with a wrong number of weights is corrupt and null."""
    rows = spark.read.parquet(path)
    if parameters is None:
        return rows
    return rows.withColumn("params", F.when(F.size("params") == parameters, F.col("params")))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").json(path)

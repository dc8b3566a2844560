"""Training bookkeeping: activity, progress, decisions and registry health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .thresholds import DEFAULT_THRESHOLD, THRESHOLD_VERSION

# Fixed values of the progress rule.
MAX_DATASET = 4400
MIN_DATASET = 1500
TARGET_HOURS = 16
TARGET_DAYS = 4
COLLECTED = 0.95
WINDOWS_PER_HOUR = 30
MIN_HOURS_PER_DAY = 6

INFER, COLLECT, TRAIN = "INFER", "COLLECT", "TRAIN"

EMPTY_DESCRIPTION = "Data collection ongoing"


def _share(value: Column, whole: float) -> Column:
    return F.least(value / F.lit(float(whole)), F.lit(1.0))


def progress(size: Column, hours: Column, days: Column) -> Column:
    """Collection progress from 0 to 0.95: the best of three tracks."""
    enough = _share(size, MIN_DATASET)
    by_coverage = _share(days, 2) * _share(hours, TARGET_HOURS) * enough
    by_days = _share(days, TARGET_DAYS) * enough
    best = F.greatest(_share(size, MAX_DATASET), by_coverage, by_days) * F.lit(COLLECTED)
    return F.bround(F.when(size > 0, F.greatest(best, F.lit(0.01))).otherwise(best), 2)


def describe(hours: Column, days: Column, done: Column) -> Column:
    return (
        F.when(done == 1.0, "Training complete")
        .when(done >= COLLECTED, "Training in progress")
        .when(days == 0, "No activity observed yet")
        .when((days > 1) & (hours < MIN_HOURS_PER_DAY), "Device used too rarely")
        .when(hours * WINDOWS_PER_HOUR < MIN_DATASET, "Produces too little data")
        .otherwise(EMPTY_DESCRIPTION)
    )


def evaluate_status(activity: DataFrame, key: str = "device_mac") -> DataFrame:
    """Training status from ``(key, hour_bucket, day_bucket, windows)`` rows.

    Buckets are made distinct before they are collected, so the arrays hold one
    entry per active hour or day.
    """
    sizes = activity.groupBy(key).agg(F.sum("windows").alias("current_size"))

    def buckets(column: str) -> DataFrame:
        distinct = activity.select(key, column).distinct()
        return distinct.groupBy(key).agg(F.sort_array(F.collect_list(column)).alias(f"distinct_{column}s"))

    status = sizes.join(buckets("hour_bucket"), key).join(buckets("day_bucket"), key)
    hours, days = F.size("distinct_hour_buckets"), F.size("distinct_day_buckets")
    return status.withColumn("progress", progress(F.col("current_size"), hours, days)).withColumn(
        "description", describe(hours, days, F.col("progress"))
    )


def merge_status(old: DataFrame, new: DataFrame, key: str = "device_mac") -> DataFrame:
    """Earlier status plus the activity of new captures, re-evaluated."""
    n = new.select(
        key,
        F.col("current_size").alias("_size"),
        F.col("distinct_hour_buckets").alias("_hours"),
        F.col("distinct_day_buckets").alias("_days"),
    )
    none = F.array().cast("array<bigint>")
    both = old.join(n, key, "full_outer")
    merged = both.select(
        key,
        (F.coalesce("current_size", F.lit(0)) + F.coalesce("_size", F.lit(0))).alias("current_size"),
        F.array_union(F.coalesce("distinct_hour_buckets", none), F.coalesce("_hours", none)).alias("distinct_hour_buckets"),
        F.array_union(F.coalesce("distinct_day_buckets", none), F.coalesce("_days", none)).alias("distinct_day_buckets"),
        F.col("progress").alias("_old"),
    )
    hours, days = F.size("distinct_hour_buckets"), F.size("distinct_day_buckets")
    # A trained device stays trained.
    done = F.when(F.col("_old") == 1.0, F.lit(1.0)).otherwise(progress(F.col("current_size"), hours, days))
    return merged.withColumn("progress", done).withColumn("description", describe(hours, days, F.col("progress"))).drop("_old")


def complete_training(status: DataFrame) -> DataFrame:
    return status.withColumns({"progress": F.lit(1.0), "description": F.lit("Training complete")})


def decide_action(done: Column, training_enabled: bool = True) -> Column:
    if not training_enabled:
        return F.lit(INFER)
    return F.when(done >= 1.0, INFER).when(done >= COLLECTED, TRAIN).otherwise(COLLECT)


# --- registry health --------------------------------------------------------


def new_devices(registry: DataFrame, status: DataFrame, key: str = "device_mac") -> DataFrame:
    return registry.select(key).distinct().join(status.select(key), key, "left_anti")


def audit(
    status: DataFrame, thresholds: DataFrame, models: DataFrame, datasets: DataFrame, base_digest: str,
    key: str = "device_mac",
) -> DataFrame:
    """First broken rule per device, null where the registry is consistent.

    Inputs are one row per device: status ``(progress, current_size)``,
    thresholds ``(threshold)``, models ``(digest)``, datasets ``(readable)``.
    """
    df = (
        status.join(thresholds.select(key, "threshold"), key, "left")
        .join(models.select(key, "digest"), key, "left")
        .join(datasets.select(key, "readable"), key, "left")
    )
    done, size, limit = F.col("progress"), F.col("current_size"), F.col("threshold")
    complete, started, untouched = done == 1.0, (done > 0.0) & (done < 1.0), done == 0.0
    no_model, no_data = F.col("digest").isNull(), F.col("readable").isNull()
    reason = (
        F.when(limit.isNull(), "no threshold")
        .when(complete & no_model, "complete without model")
        .when(complete & (F.col("digest") == base_digest), "complete with base model")
        .when(complete & (limit == DEFAULT_THRESHOLD), "complete with default threshold")
        .when(started & (size == 0), "in progress with empty dataset")
        .when(started & no_data, "in progress without dataset")
        .when(started & ~F.col("readable"), "in progress with unreadable dataset")
        .when(untouched & (size != 0), "not started with data")
        .when(untouched & no_data, "not started without dataset")
        .when(untouched & no_model, "not started without model")
        .when(untouched & (F.col("digest") != base_digest), "not started with changed model")
        .when(untouched & (limit != DEFAULT_THRESHOLD), "not started with own threshold")
    )
    return df.withColumn("reason", reason)


def initial_components(devices: DataFrame, base_digest: str) -> DataFrame:
    """What a new or reset device starts with; feed it to the stores."""
    none = F.array().cast("array<bigint>")
    return devices.withColumns(
        {
            "threshold": F.lit(DEFAULT_THRESHOLD),
            "version": F.lit(THRESHOLD_VERSION),
            "digest": F.lit(base_digest),
            "current_size": F.lit(0).cast("long"),
            "distinct_hour_buckets": none,
            "distinct_day_buckets": none,
            "progress": F.lit(0.0),
            "description": F.lit(EMPTY_DESCRIPTION),
        }
    )


def stale_threshold_action(status: DataFrame, thresholds: DataFrame, datasets: DataFrame, key: str = "device_mac") -> DataFrame:
    """What an outdated threshold needs: recompute, bump, reset or keep."""
    df = status.join(thresholds.select(key, "threshold", "version"), key, "left").join(
        datasets.select(key, F.lit(True).alias("_data")), key, "left"
    )
    current = F.col("version") == THRESHOLD_VERSION
    action = (
        F.when(F.col("version").isNull(), "reset")
        .when(current, "keep")
        .when(F.col("progress") != 1.0, "bump")
        .when(F.col("_data").isNull(), "reset")
        .otherwise("recompute")
    )
    return df.withColumn("threshold_action", action).drop("_data")


def refresh_thresholds(actions: DataFrame, training_scores: DataFrame) -> DataFrame:
    """New threshold rows: recomputed where stale, otherwise with a new version."""
    from .thresholds import final_threshold

    stale = actions.filter("threshold_action = 'recompute'").select("device_mac")
    recomputed = final_threshold(training_scores.join(stale, "device_mac"))
    bumped = actions.filter("threshold_action = 'bump'").select("device_mac", "threshold")
    return recomputed.unionByName(bumped).withColumn("version", F.lit(THRESHOLD_VERSION))

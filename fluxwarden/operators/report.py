"""Device reports, verdicts and the merged report per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from . import ordered
from .training import COLLECT, INFER, TRAIN

# Score ranges of the verdicts.
ALERT_RANGE = (50.0, 99.0)
NORMAL_RANGE = (0.0, 49.99)
MAX_CONSECUTIVE_ERRORS = 3


def steady_fraction(key: Column) -> Column:
    """A reproducible number in [0, 1) per key, in place of a random one."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def verdict(reports: DataFrame, key: str = "device_mac") -> DataFrame:
    """Type, description and score from ``action, num_anomalies, error``."""
    failed = F.col("error").isNotNull()
    infer = ~failed & (F.col("action") == INFER)
    found = infer & (F.col("num_anomalies") > 0)
    clean = infer & (F.col("num_anomalies") == 0)

    def between(low: float, high: float) -> Column:
        return F.round(F.lit(low) + steady_fraction(F.col(key)) * F.lit(high - low), 2)

    return reports.withColumns(
        {
            "type": F.when(found, "Alert").otherwise("Normal"),
            "description": F.when(failed, "Error occured")
            .when(found, F.concat(F.col("num_anomalies").cast("string"), F.lit(" Anomalies detected")))
            .when(clean, "No Anomalies detected")
            .otherwise(""),
            "score": F.when(found, between(*ALERT_RANGE)).when(clean, between(*NORMAL_RANGE)).otherwise(0.0),
        }
    )


def device_report(state: DataFrame) -> DataFrame:
    """Nested report per device; the fields depend on what was done with it.

    Needs ``device_mac, action, error, num_anomalies, processed_at, current_size,
    progress, description, distinct_hour_buckets, distinct_day_buckets,
    threshold, model``.
    """
    action, ok = F.col("action"), F.col("error").isNull()
    infer, collect, train = ok & (action == INFER), ok & (action == COLLECT), ok & (action == TRAIN)
    report = F.struct(
        "action",
        "error",
        F.when(infer, F.col("num_anomalies")).alias("num_anomalies"),
        F.when(infer & (F.col("num_anomalies") > 0), F.col("processed_at")).alias("first_occurrence"),
        F.when(collect, F.col("current_size")).alias("dataset_size"),
        F.when(collect, F.col("progress") * 100).alias("progress"),
        F.when(collect, F.col("description")).alias("status_description"),
        F.when(collect, F.col("distinct_hour_buckets")).alias("distinct_hour_buckets"),
        F.when(collect, F.col("distinct_day_buckets")).alias("distinct_day_buckets"),
        F.when(train, F.col("threshold")).alias("threshold"),
        F.when(train, S.base64_text(F.col("model"))).alias("model_base64"),
    )
    return state.select("device_mac", report.alias("ml"))


def status_view(status: DataFrame) -> DataFrame:
    return status.select(
        S.mac_display(F.col("device_mac")).alias("mac"), (F.col("progress") * 100).alias("progress"), "description"
    )


def join_reports(registry: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per registered device with its alerts and its verdict.

    All three sides are one row per device; anything about an unregistered
    device drops out.
    """
    none = F.struct(F.lit("Normal").alias("type"), F.lit("No data").alias("description"), F.lit(0.0).alias("score"))
    entries = alerts.schema["suricata"].dataType
    return (
        registry.select("device_mac")
        .distinct()
        .join(alerts, "device_mac", "left")
        .join(verdicts.select("device_mac", F.struct("type", "description", "score").alias("ml")), "device_mac", "left")
        .select(
            S.mac_display(F.col("device_mac")).alias("mac"),
            F.coalesce("suricata", F.array().cast(entries)).alias("suricata"),
            F.coalesce("ml", none).alias("ml"),
        )
    )


def merge_statistics(left: Column, right: Column) -> Column:
    """Union of two statistics maps; the right side wins."""
    keys = F.map_keys(right)
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(keys, k)), right)


def report_head(captures: DataFrame) -> DataFrame:
    """Status of a capture from the errors of both analyses."""
    failed = F.col("rule_error").isNotNull() | F.col("model_error").isNotNull()
    message = F.to_json(
        F.struct(
            F.coalesce("rule_error", F.lit("")).alias("rb"), F.coalesce("model_error", F.lit("")).alias("ml")
        )
    )
    return captures.withColumn(
        "result",
        F.struct(
            F.when(failed, "error").otherwise("success").alias("status"),
            F.when(failed, message).otherwise("").alias("message"),
        ),
    )


def error_streak(runs: DataFrame, keys: list[str], order: str, ok: str = "ok", bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Position in the current streak of failures and whether it raises an error.

    Every third failure in a row raises and starts a new count.
    """
    failed = F.when(F.col(ok), 0).otherwise(1)
    counted = ordered.running_sum(runs, keys, order, failed, "_failures", bits)
    reset = ordered.running_max_before(
        counted, keys, order, F.when(F.col(ok), F.col("_failures")), "_before", bits
    )
    streak = F.when(F.col(ok), 0).otherwise(F.col("_failures") - F.coalesce("_before", F.lit(0)))
    return (
        reset.withColumn("streak", streak)
        .withColumn("raises", (F.col("streak") > 0) & (F.col("streak") % MAX_CONSECUTIVE_ERRORS == 0))
        .drop("_failures", "_before")
    )

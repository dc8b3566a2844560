"""The whole analysis of captures as one plan per result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import (
    alerts as A, capture_report as CR, features as FT, models as M, packets as P, report as R, scoring as SC, traffic as T,
)
from ..sources import captures as C


@dataclass
class Analysis:
    packets: DataFrame
    totals: DataFrame
    traffic: DataFrame
    features: DataFrame


def read_packets(captures: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributed packets and the labelled frames they come from."""
    labelled = P.label_frames(C.read_captures(captures).filter("read_error is null"), registry)
    kept = P.orient(P.assign_device(labelled.filter("disposition = 'accepted'")))
    return kept.withColumn("packet_length", F.col("frame_len").cast("long")).select(*P.PACKET_COLUMNS), labelled


def read_failures(captures: DataFrame) -> DataFrame:
    """The reader's error of every capture that could not be read to its end."""
    failed = C.read_captures(captures).filter("read_error is not null")
    return failed.groupBy("capture_id").agg(F.min("read_error").alias("read_error"))


def analyse_captures(
    captures: DataFrame, registry: DataFrame, ranges: DataFrame, carry: DataFrame | None = None
) -> Analysis:
    packets, labelled = read_packets(captures, registry)
    return Analysis(
        packets=packets,
        totals=T.capture_totals(labelled, captures, read_failures(captures)),
        traffic=T.external_ip_traffic(packets, ranges, ["capture_id", "device_mac"]),
        features=FT.window_features(packets, carry=carry),
    )


def score_features(features: DataFrame, models: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores and anomaly flags in window order per device; the window start
    orders the scores, also over several captures."""
    vectors = FT.feature_vector(features).select("capture_id", "device_mac", F.col("windowid").alias("vec_seq"), "vector")
    # 2^36 microseconds (19 h) per part hold at most 3,436 windows of a device.
    scores = M.score_windows(vectors, models, bits=36, tags=("capture_id",)).withColumnRenamed("vec_seq", "score_seq")
    limited = scores.join(thresholds.select("device_mac", "threshold"), "device_mac", "left")
    return SC.anomaly_flags(limited, bits=36)


NO_MODEL = "No usable model"


def verdicts(flags: DataFrame, status: DataFrame, training_enabled: bool = True, keys: tuple[str, ...] = ("device_mac",)) -> DataFrame:
    """A verdict for every device (or other keys) with at least one window. Devices without data have none, which the
    merged report shows as "No data"; a device that should be judged but has windows without a score reports an error."""
    from ..operators.training import INFER, decide_action

    counts = SC.anomaly_counts(flags.withColumn("_unscored", F.col("score").isNull().cast("long")), keys, ("_unscored",))
    action = decide_action(F.col("progress"), training_enabled)
    state = counts.join(status.select("device_mac", "progress"), "device_mac").select(
        *keys, action.alias("action"), "num_anomalies",
        F.when((action == INFER) & (F.col("_unscored") > 0), F.lit(NO_MODEL)).alias("error"),
    )
    return R.verdict(state)


@dataclass
class Registry:
    """What is known about the devices: ``devices`` (site_id, device_mac, position), ``status`` (device_mac, progress),
    ``models`` and ``thresholds`` (device_mac, threshold)."""

    devices: DataFrame
    status: DataFrame
    models: DataFrame
    thresholds: DataFrame


def model_results(captures: DataFrame, analysis: Analysis, registry: Registry, training_enabled: bool = True) -> DataFrame:
    """The model side of the report of every capture (capture_id, site_id)."""
    flags = score_features(analysis.features, registry.models, registry.thresholds)
    found = verdicts(flags, registry.status, training_enabled, CR.DEVICE)
    return CR.model_side(captures, registry.devices, analysis.totals, analysis.traffic, found)


def rule_results(runs: DataFrame, alert_events: DataFrame, registry: Registry) -> DataFrame:
    """The rule side of the report of every capture; events carry their ``capture_id``."""
    alerts = A.alert_device(A.only_alerts(alert_events), registry.devices)
    return CR.rule_side(runs, A.alert_rollup(alerts, CR.DEVICE))


def capture_report(
    captures: DataFrame, analysis: Analysis, runs: DataFrame, alert_events: DataFrame, registry: Registry, training_enabled: bool = True
) -> DataFrame:
    """One report per capture from both analyses; see ``operators.capture_report``."""
    model = model_results(captures, analysis, registry, training_enabled)
    pairs = CR.pair(rule_results(runs, alert_events, registry), model)
    return CR.compose(pairs.join(captures.select("capture_id", "site_id"), "capture_id", "left"), registry.devices)


def merged_report(registry: DataFrame, alert_events: DataFrame, device_verdicts: DataFrame) -> DataFrame:
    rollup = A.alert_rollup(A.alert_device(A.only_alerts(alert_events), registry))
    return R.join_reports(registry, A.as_report_entries(rollup), device_verdicts)

"""Look-back rule and other ordered operations on score series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered

# Fixed values of the look-back rule.
LOOKBACK = 15
FRAME = LOOKBACK + 1
MIN_ABOVE = 4
SHARE_ABOVE = FRAME * 0.34
HALF_ABOVE = 8


def lookback_flag(frame: Column, score: Column, threshold: Column) -> Column:
    """Anomaly rule on the array of the last 16 scores, the current one last."""
    above = F.size(F.filter(frame, lambda s: s > threshold))
    mean = F.aggregate(frame, F.lit(0.0), lambda a, s: a + s) / F.lit(float(FRAME))
    return (
        (F.size(frame) == FRAME)
        & (score > threshold)
        & (above >= MIN_ABOVE)
        & (((mean > threshold) & (above >= SHARE_ABOVE)) | (above >= HALF_ABOVE))
    )


def anomaly_flags(scores: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """``is_anomaly`` for every score; needs ``device_mac, score_seq, score, threshold``."""
    near = ordered.preceding(scores, ["device_mac"], "score_seq", F.col("score"), LOOKBACK, "_prev", bits)
    frame = F.concat("_prev", F.array("score"))
    return near.withColumn("is_anomaly", lookback_flag(frame, F.col("score"), F.col("threshold"))).drop("_prev")


def anomaly_counts(flags: DataFrame, keys: tuple[str, ...] = ("device_mac",), sums: tuple[str, ...] = ()) -> DataFrame:
    """Windows and anomalies of a device or other keys, and the sums of further columns."""
    return flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("is_anomaly").cast("long")).alias("num_anomalies"),
        *[F.sum(c).alias(c) for c in sums],
    )


def score_tail(scores: DataFrame, k: int = LOOKBACK, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """The newest ``k`` scores of each device, the carry-over to the next capture."""
    return ordered.latest(scores, ["device_mac"], "score_seq", k, bits)


def score_history(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Carried scores in front of new ones."""
    return previous.unionByName(new)


def rolling_stats(scores: DataFrame, rows: int = 15, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Trailing mean and population deviation over up to ``rows`` scores."""
    near = ordered.preceding(scores, ["device_mac"], "score_seq", F.col("score"), rows - 1, "_prev", bits)
    frame = F.concat("_prev", F.array("score"))
    size = F.size(frame)
    mean = F.aggregate(frame, F.lit(0.0), lambda a, s: a + s) / size
    near = near.withColumn("_frame", frame).withColumn("rolling_mean", mean)
    squares = F.aggregate(
        "_frame", F.lit(0.0), lambda a, s: a + (s - F.col("rolling_mean")) * (s - F.col("rolling_mean"))
    )
    return near.withColumn("rolling_std", F.sqrt(squares / F.size("_frame"))).drop("_prev", "_frame")

"""Exact ranks and percentiles without gathering a group into one task.

Equal values are counted first. Distinct values are cut into buckets by a fixed
function of the value (256 per octave), so a key of any size is spread over
many tasks; one row per bucket carries the rank offset. A percentile is then a
conditional maximum over ranked rows, which aggregates before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered

BUCKETS_PER_OCTAVE = 256
ZERO_BUCKET = -(1 << 20)
BLOCK = ordered.BLOCK


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a non-negative value."""
    return F.when(value > 0, F.floor(F.log2(value) * BUCKETS_PER_OCTAVE)).otherwise(F.lit(ZERO_BUCKET))


def ranked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add to counted rows: ``below`` (rows with a smaller value), ``total`` and
    the neighbouring distinct values ``prev_value`` and ``next_value``."""
    rows = rows.withColumn(BLOCK, value_bucket(F.col(value)))
    summary = rows.groupBy(*keys, BLOCK).agg(
        F.sum("n").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    key = Window.partitionBy(*keys)
    by_bucket = key.orderBy(BLOCK)
    borders = summary.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(key).alias("total"),
        F.lag("_max").over(by_bucket).alias("_prev"),
        F.lead("_min").over(by_bucket).alias("_next"),
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(value)
    local = rows.withColumns(
        {
            "_below": F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_lag": F.lag(value).over(inside),
            "_lead": F.lead(value).over(inside),
        }
    )
    return (
        local.join(borders, [*keys, BLOCK])
        .withColumns(
            {
                "below": F.col("_below") + F.col("_offset"),
                "prev_value": F.coalesce("_lag", "_prev"),
                "next_value": F.coalesce("_lead", "_next"),
            }
        )
        .drop("_below", "_lag", "_lead", "_offset", "_prev", "_next")
    )


def at_index(value: str, index: Column) -> Column:
    """Aggregate: the value at a 0-based rank."""
    return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))


def quantile(value: str, p: float, total: Column | None = None) -> Column:
    """Aggregate: percentile with linear interpolation between ranks."""
    total = F.col("total") if total is None else total
    h = (total - 1) * F.lit(p)
    low, high = at_index(value, F.floor(h)), at_index(value, F.ceil(h))
    fraction = F.max(h - F.floor(h))
    return low + (high - low) * fraction


def count_above_quantile(p: float) -> Column:
    """Aggregate: rows above that percentile, read off the ranks."""
    index = F.floor((F.col("total") - 1) * F.lit(p))
    hit = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
    return F.max(F.when(hit, F.col("total") - F.col("below") - F.col("n")))


def weighted_median_deviation(rows: DataFrame, keys: list[str], value: str, centre: str) -> DataFrame:
    """Median of |value - centre| per key over counted rows holding ``centre``."""
    deviations = (
        rows.withColumn("_dev", F.abs(F.col(value) - F.col(centre))).groupBy(*keys, "_dev").agg(F.sum("n").alias("n"))
    )
    return ranked(deviations, keys, "_dev").groupBy(*keys).agg(quantile("_dev", 0.5).alias("mad"))

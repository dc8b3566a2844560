"""Anomaly thresholds per device from the distribution of its training scores.

A strategy takes ``(device_mac, score)`` rows, or a prepared ``ScoreSet``, and
returns ``(device_mac, threshold)``. ``final_threshold`` tries the strategies in order and gates the
result by percentiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from . import order_stats as OS, ordered

KEY = "device_mac"
KEYS = [KEY]

# Grid sizes, masses and factors of the strategies.
GRID = 4096
POINT_GRID = 2048
REGION_MASS = 0.99
REGION_BANDWIDTH = 0.9
ISLAND_MASS = 0.05
LEFT_MASS = 0.97
TAIL_PENALTY = 0.7
GAP_POSITION = 0.7
SAFETY = 1.2
DEFAULT_THRESHOLD = 0.0001
THRESHOLD_VERSION = "0.9"

# Bandwidths beyond which a score does not count where only mass matters. The log-density search and the lowering of
# a level look at densities below any such bound and use whole kernels.
REACH = 8.0
PART_SCORES = 4096


@dataclass(frozen=True)
class ScoreSet:
    """Scores with what every strategy needs, computed once.

    ``ranks`` holds the distinct scores with counts and ranks, ``stats`` one row
    of moments per device. Both are written to the shared folder: the threshold
    search reads them many times.
    """

    scores: DataFrame
    ranks: DataFrame
    stats: DataFrame

    def only(self, devices: DataFrame) -> ScoreSet:
        return ScoreSet(
            self.scores.withColumn(OS.BLOCK, OS.value_bucket(F.col("score"))).transform(
                lambda df: ordered.attach(df, devices, KEYS, how="inner").drop(OS.BLOCK)
            ),
            ordered.attach(self.ranks, devices, KEYS, how="inner"),
            self.stats.join(devices, KEY, "left_semi"),
        )


def ranked_scores(scores: DataFrame) -> DataFrame:
    return OS.ranked(OS.counted(scores, KEYS, "score"), KEYS, "score")


def prepare(scores: DataFrame | ScoreSet) -> ScoreSet:
    if isinstance(scores, ScoreSet):
        return scores
    return ScoreSet(scores, cut_lineage(ranked_scores(scores)), cut_lineage(moments(scores)))


def moments(scores: DataFrame) -> DataFrame:
    return scores.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.stddev_samp("score").alias("std_sample"),
    )


def _order_statistics(ranks: DataFrame) -> DataFrame:
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return ranks.groupBy(KEY).agg(
        *[OS.quantile("score", p).alias(name) for name, p in points.items()],
        OS.at_index("score", F.floor(F.col("total") * F.lit(0.9))).alias("rank90"),
        OS.at_index("score", F.floor(F.col("total") * F.lit(0.6))).alias("rank60"),
        OS.count_above_quantile(0.95).alias("above_p95"),
        OS.count_above_quantile(0.99).alias("above_p99"),
    )


def profile(scores: DataFrame | ScoreSet) -> DataFrame:
    """Count, moments, percentiles and median absolute deviation per device."""
    known = prepare(scores)
    ranks = known.ranks
    stats = cut_lineage(_order_statistics(ranks))
    centred = ordered.attach(ranks.select(KEY, "score", "n", OS.BLOCK), stats.select(KEY, "median"), KEYS)
    mad = OS.weighted_median_deviation(centred, KEYS, "score", "median")
    return known.stats.join(stats, KEY).join(mad, KEY)


# --- trimming and subsets ---------------------------------------------------


def trimmed(scores: DataFrame | ScoreSet) -> DataFrame:
    """Counted scores without the top 1 % and without isolated highest values.

    After the cut at rank ceil(0.99 n), the highest value goes while it exceeds
    1.1 times the next lower one, at most max(1, floor(0.01 n)) times. ``n`` and
    ``total`` describe what is left.
    """
    ranks = prepare(scores).ranks
    cut = F.ceil(F.col("total") * F.lit(0.99))
    kept = ranks.filter(F.col("below") < cut).withColumn("n", F.least(F.col("n"), cut - F.col("below")))
    holds = (F.col("n") > 1) | F.col("prev_value").isNull() | (F.col("score") <= F.col("prev_value") * 1.1)
    # Ranks count rows, so everything above the highest value that holds is removable.
    limits = kept.groupBy(KEY).agg(
        F.max(F.when(holds, F.col("below") + F.col("n"))).alias("_held"),
        F.max(cut).alias("_cut"),
        F.max(F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(0.01)))).alias("_allowed"),
    )
    limits = limits.select(
        KEY, (F.col("_cut") - F.least(F.col("_cut") - F.col("_held"), F.col("_allowed"))).alias("_left")
    )
    return (
        ordered.attach(kept, limits, KEYS)
        .filter(F.col("below") < F.col("_left"))
        .withColumn("n", F.least(F.col("n"), F.col("_left") - F.col("below")))
        .withColumn("total", F.col("_left"))
        .withColumn("next_value", F.when(F.col("below") + F.col("n") < F.col("total"), F.col("next_value")))
        .drop("_left")
    )


def outlier_subset(scores: DataFrame) -> DataFrame:
    """Scores above the one at rank floor(0.6 n), as counted rows."""
    ranks = prepare(scores).ranks
    cut = ranks.groupBy(KEY).agg(OS.at_index("score", F.floor(F.col("total") * F.lit(0.6))).alias("_cut"))
    rows = ordered.attach(ranks.select(KEY, "score", "n", OS.BLOCK), cut, KEYS)
    return rows.filter(F.col("score") > F.col("_cut")).select(KEY, "score", "n")


# --- kernel density ---------------------------------------------------------


def kernel_density(
    scores: DataFrame | ScoreSet, factor: float, size: int = GRID, observed_range: bool = False, reach: float | None = None
) -> DataFrame:
    """Gaussian kernel density on an even grid: ``(device_mac, pos, x, pdf)``.

    With ``reach`` a score adds nothing to points more than so many bandwidths
    away from it. The density then lacks at most exp(-reach^2 / 2) of a kernel's
    peak, averaged over the scores: 1.3e-14 for a reach of 8.

    Distinct scores are spread by (device, part) with about ``PART_SCORES`` of
    them in a part, each part is summed to one vector of ``size`` values in
    NumPy, and the vectors are added up by Spark. A device of any size is so
    shared by as many tasks as it needs.
    """
    known = prepare(scores)
    stats = known.stats
    low = F.col("min") if observed_range else F.lit(0.0)
    high = F.col("max") if observed_range else F.lit(1.0)
    grid = stats.select(
        KEY,
        F.col("n").alias("_total"),
        (F.pow(F.col("n") * F.lit(0.75), F.lit(-0.2)) * F.col("std_sample") * F.lit(factor)).alias("_h"),
        low.alias("_lo"),
        ((high - low) / F.lit(size - 1)).alias("_step"),
    ).filter((F.col("_h") > 0) & (F.col("_step") > 0))
    rows = ordered.attach(known.ranks.select(KEY, "score", "n", OS.BLOCK), grid, KEYS, how="inner")
    parts = F.ceil(F.col("_total") / F.lit(PART_SCORES))
    spread = (
        rows.withColumn("_part", F.pmod(F.xxhash64("score"), parts))
        .repartition(_compute_partitions(rows), KEY, "_part")
        .select(KEY, "score", "n", "_h", "_lo", "_step")
        .sortWithinPartitions(KEY)
    )
    vectors = spread.mapInPandas(lambda batches: _kernel_sums(batches, size, reach), "device_mac string, sums array<double>")
    mass = vectors.select(KEY, F.posexplode("sums").alias("pos", "_mass")).groupBy(KEY, "pos").agg(
        F.sum("_mass").alias("_mass")
    )
    return mass.join(grid, KEY).select(
        KEY,
        "pos",
        (F.col("_lo") + F.col("pos") * F.col("_step")).alias("x"),
        (F.col("_mass") / (F.col("_total") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("pdf"),
    )


def _compute_partitions(df: DataFrame) -> int:
    """Task count for work that is heavy on small inputs, which adaptive
    execution would otherwise fold into one task."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _kernel_sums(batches, size: int, reach: float | None):
    """Sum of the weighted kernels of each device of a batch on its grid. Scores
    are taken in order, so that a few of them reach few points."""
    positions = np.arange(size, dtype=np.float64)
    step_rows = 256 if reach is None else 64
    for pdf in batches:
        for device, group in pdf.groupby(KEY, sort=False):
            lo, step, h = (float(group[c].iat[0]) for c in ("_lo", "_step", "_h"))
            points = (lo + positions * step) / h
            order = np.argsort(group["score"].to_numpy(np.float64), kind="stable")
            centres = group["score"].to_numpy(np.float64)[order] / h
            weights = group["n"].to_numpy(np.float64)[order]
            sums = np.zeros(size)
            for start in range(0, len(centres), step_rows):
                near = centres[start : start + step_rows]
                first, last = (0, size) if reach is None else np.searchsorted(points, (near[0] - reach, near[-1] + reach))
                z = near[:, None] - points[None, first:last]
                sums[first:last] += weights[start : start + step_rows] @ np.exp(-0.5 * z * z)
            yield pd.DataFrame({KEY: [device], "sums": [sums]})


def _islands(rows: DataFrame) -> DataFrame:
    """Runs of neighbouring grid points with their mass and right edge."""
    order = Window.partitionBy(KEY).orderBy("pos")
    return (
        rows.withColumn("_run", F.col("pos") - F.row_number().over(order))
        .groupBy(KEY, "_run")
        .agg(F.sum("mass").alias("mass"), F.max("pos").alias("edge"))
    )


def _normalised(density: DataFrame) -> DataFrame:
    """Grid rows with their share of the total mass; at most GRID rows per device."""
    return density.withColumn("mass", F.col("pdf") / F.sum("pdf").over(Window.partitionBy(KEY)))


def region_threshold(scores: DataFrame | ScoreSet) -> DataFrame:
    """Right edge of the densest region holding 99 % of the mass.

    Islands with less than 5 % are ignored unless there is nothing else.
    """
    known = prepare(scores)
    grid = _normalised(kernel_density(known, REGION_BANDWIDTH, reach=REACH))
    densest = Window.partitionBy(KEY).orderBy(F.col("pdf").desc(), "pos")
    cumulated = grid.withColumn("_cum", F.sum("mass").over(densest.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.max(F.when(F.col("_cum") >= REGION_MASS, F.col("pdf"))).over(Window.partitionBy(KEY))
    region = cumulated.withColumn("_level", F.coalesce(level, F.lit(0.0))).filter(F.col("pdf") >= F.col("_level"))
    edges = _islands(region).groupBy(KEY).agg(
        F.max(F.when(F.col("mass") >= ISLAND_MASS, F.col("edge"))).alias("_kept"),
        F.max_by("edge", F.struct("mass", -F.col("edge"))).alias("_largest"),
    )
    found = edges.select(KEY, (F.coalesce("_kept", "_largest") / F.lit(float(GRID - 1))).alias("_edge"))
    # Without spread there is no density; the 99th percentile takes its place.
    fallback = known.ranks.groupBy(KEY).agg(OS.quantile("score", REGION_MASS).alias("_q"))
    return fallback.join(found, KEY, "left").select(KEY, F.coalesce("_edge", "_q").alias("threshold"))


def valley_threshold(scores: DataFrame | ScoreSet) -> DataFrame:
    """Middle of the neighbouring distinct scores with the sharpest density drop."""
    known = prepare(scores)
    density = cut_lineage(kernel_density(known, 1.0, POINT_GRID, observed_range=True))
    pairs = density.select(KEY, F.col("pos").alias("_j"), F.col("pdf").alias("_f0")).join(
        density.select(KEY, (F.col("pos") - 1).alias("_j"), F.col("pdf").alias("_f1")), [KEY, "_j"], "full_outer"
    ).na.fill(0.0, ["_f0", "_f1"])
    bounds = known.stats.select(KEY, F.col("min").alias("_lo"), F.col("max").alias("_hi"))
    rows = ordered.attach(known.ranks, bounds, KEYS)
    step = (F.col("_hi") - F.col("_lo")) / F.lit(POINT_GRID - 1)

    def with_density(df: DataFrame, value: str, out: str) -> DataFrame:
        place = F.when(step > 0, (F.col(value) - F.col("_lo")) / step).otherwise(F.lit(0.0))
        df = df.withColumn("_place", place).withColumn(
            "_j", F.least(F.floor("_place"), F.lit(POINT_GRID - 2)).cast("int")
        )
        near = df.join(pairs, [KEY, "_j"], "left")
        value_at = F.col("_f0") + (F.col("_f1") - F.col("_f0")) * (F.col("_place") - F.col("_j"))
        flat = F.when(F.col("_hi") <= F.col("_lo") + 1e-12, F.lit(1.0)).otherwise(F.coalesce(value_at, F.lit(0.0)))
        return near.withColumn(out, F.greatest(flat, F.lit(1e-300))).drop("_place", "_j", "_f0", "_f1")

    steps = with_density(with_density(rows, "score", "_left").filter("next_value is not null"), "next_value", "_right")
    drop = F.log("_left") - F.log("_right")
    middle = (F.col("score") + F.col("next_value")) / 2
    best = steps.groupBy(KEY).agg(F.max_by(middle, F.struct(drop, -F.col("score"))).alias("_mid"))
    # A device with one distinct score keeps that score.
    return bounds.join(best, KEY, "left").select(
        KEY,
        F.when(F.col("_mid").isNull(), F.col("_lo"))
        .otherwise(F.least(F.greatest("_mid", F.lit(0.0)), F.lit(1.0)))
        .alias("threshold"),
    )


def connected_threshold(scores: DataFrame | ScoreSet) -> DataFrame:
    """Right edge of the lowest density level at which the set above it is one piece.

    The k densest grid points are contiguous exactly while the span of their
    positions equals their number; equal densities enter together.
    """
    known = prepare(scores)
    grid = _normalised(kernel_density(known, 1.0))
    densest = Window.partitionBy(KEY).orderBy(F.col("pdf").desc()).rangeBetween(Window.unboundedPreceding, 0)
    span = F.max("pos").over(densest) - F.min("pos").over(densest) + 1
    device = Window.partitionBy(KEY)
    levels = grid.withColumn("_split", span != F.count("pos").over(densest)).withColumn(
        "_split_at", F.max(F.when(F.col("_split"), F.col("pdf"))).over(device)
    ).withColumn("_top", F.max("pdf").over(device))
    edges = levels.groupBy(KEY).agg(
        F.max("_split_at").alias("_split_at"),
        F.max(F.when(F.col("pdf") > F.col("_split_at"), F.col("pos"))).alias("_edge"),
    )
    # Several equally high peaks: the heaviest of them.
    peaks = _islands(levels.filter(F.col("pdf") == F.col("_top"))).groupBy(KEY).agg(
        F.max_by("edge", F.struct("mass", -F.col("edge"))).alias("_peak")
    )
    edge = F.when(F.col("_split_at").isNull(), F.lit(GRID - 1)).otherwise(F.coalesce("_edge", "_peak"))
    found = edges.join(peaks, KEY).select(KEY, (edge / F.lit(float(GRID - 1))).alias("_t"))
    return known.stats.select(KEY).join(found, KEY, "left").select(KEY, F.coalesce("_t", F.lit(1.0)).alias("threshold"))


def gap_threshold(scores: DataFrame | ScoreSet) -> DataFrame:
    """Inside the widest relative gap that leaves at most 3 % above it."""
    rows = cut_lineage(trimmed(scores))
    left_share = (F.col("below") + F.col("n")) / F.col("total")
    gap = F.col("next_value") - F.col("score")
    weight = (gap / F.greatest("score", F.lit(1e-12))) / F.pow(
        F.lit(1.0) - left_share + F.lit(1e-12), F.lit(TAIL_PENALTY)
    )
    usable = F.col("next_value").isNotNull() & (left_share >= LEFT_MASS)
    split = rows.groupBy(KEY).agg(
        F.max("total").alias("_total"),
        F.max("score").alias("_max"),
        F.count(F.lit(1)).alias("_distinct"),
        OS.quantile("score", 0.999).alias("_cap"),
        F.max_by(
            F.when(usable, F.struct(F.col("score").alias("s"), gap.alias("g"), (F.col("below") + F.col("n")).alias("c"))),
            F.when(usable, F.struct(weight, -F.col("below"))),
        ).alias("_best"),
    )
    # No gap in the allowed region: the first rank that leaves 3 %.
    first_allowed = F.ceil(F.col("_total") * F.lit(LEFT_MASS))
    split = split.select(
        KEY, "_total", "_max", "_distinct", "_cap",
        F.coalesce("_best.s", "_max").alias("_s"),
        F.coalesce("_best.g", F.lit(0.0)).alias("_g"),
        F.coalesce("_best.c", first_allowed).alias("_left"),
    )
    split = cut_lineage(split)
    base = F.col("_s") + F.lit(GAP_POSITION) * F.col("_g")
    left = (
        ordered.attach(rows.select(KEY, "score", "n", "below", OS.BLOCK), split.select(KEY, "_left"), KEYS)
        .filter(F.col("below") < F.col("_left"))
        .withColumn("n", F.least(F.col("n"), F.col("_left") - F.col("below")))
    )
    middle = left.groupBy(KEY).agg(OS.quantile("score", 0.5, F.col("_left")).alias("_median"))
    mad = OS.weighted_median_deviation(ordered.attach(left, middle, KEYS), KEYS, "score", "_median")
    leeway = F.least(F.lit(3.0) * (F.col("mad") + F.lit(1e-12)), base * 0.1)
    value = F.least(F.greatest(F.least(base + leeway, F.col("_cap")), F.lit(0.0)), F.lit(1.0))
    # Fewer than 34 ranks leave no gap with 3 % above it: the split is then behind the last rank.
    result = F.when(F.col("_distinct") == 1, F.least("_max", "_cap")).otherwise(value)
    return split.join(mad, KEY).select(KEY, result.alias("threshold"))


def tukey_threshold(scores: DataFrame) -> DataFrame:
    """Upper quartile plus 1.5 interquartile ranges, capped by the 99.9th percentile."""
    clipped = scores.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    stats = _order_statistics(ranked_scores(clipped))
    fence = F.col("p75") + F.lit(1.5) * F.greatest(F.col("p75") - F.col("p25"), F.lit(1e-12))
    value = F.greatest(F.least(fence, F.col("p999")), F.col("p75"))
    return stats.select(KEY, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("threshold"))


# Ordered list of strategies; append or replace entries to change the search.
STRATEGIES = [region_threshold, valley_threshold, connected_threshold, gap_threshold]


# --- adjustments ------------------------------------------------------------


def needle_override(stats: DataFrame, base: str = "base", out: str = "override") -> DataFrame:
    """Move a base threshold that sits in a compact high tail towards the bulk.

    ``stats`` holds the columns of :func:`profile` and the base threshold.
    """
    med, p90, p95, p99, b = (F.col(c) for c in ("median", "p90", "p95", "p99", base))
    mad = F.col("mad") + F.lit(1e-12)
    lower = F.least(med + 6.0 * mad, p90)
    lifted = p90 + 0.1 * F.greatest(p95 - p90, F.lit(0.0))
    ceiling = p95 - 0.1 * F.greatest(p95 - med, F.lit(1e-12))
    moved = F.least(F.greatest(lower, lifted), ceiling)
    needle = (p95 > 50.0 * med) & ~(F.abs(b - p90) < F.abs(b - p99))
    return stats.withColumn(out, F.when(needle, moved).otherwise(b))


def slow_increment(scores: DataFrame | ScoreSet, start: DataFrame, factor: float) -> DataFrame:
    """Raise ``(device_mac, start)`` by ``factor`` until a step passes few scores.

    Step k covers the scores in [start * f^k, start * f^(k+1)). The result is
    start * f^k for the first step that covers at most floor(0.005 n) scores:
    the number of leading steps that cover more.
    """
    ranks = prepare(scores).ranks.select(KEY, "score", "n", F.col("total").alias("_total"), OS.BLOCK)
    rows = ordered.attach(ranks, start.select(KEY, "start"), KEYS, how="inner").filter(
        (F.col("start") > 0) & (F.col("score") >= F.col("start"))
    )
    step = F.floor(F.log(F.col("score") / F.col("start")) / F.lit(math.log(factor)))
    busy = (
        rows.groupBy(KEY, step.alias("_k"))
        .agg(F.sum("n").alias("_covered"), F.max("_total").alias("_total"))
        .filter(F.col("_covered") > F.floor(F.col("_total") * F.lit(0.005)))
    )
    in_order = Window.partitionBy(KEY).orderBy("_k")
    leading = busy.withColumn("_gapless", F.row_number().over(in_order) - 1 == F.col("_k")).groupBy(KEY).agg(
        F.sum(F.when(F.col("_gapless"), 1).otherwise(0)).alias("_steps")
    )
    return start.join(leading, KEY, "left").select(
        KEY, (F.col("start") * F.pow(F.lit(factor), F.coalesce("_steps", F.lit(0)))).alias("raised")
    )


def base_thresholds(scores: DataFrame | ScoreSet) -> DataFrame:
    """First strategy whose value, raised by 20 %, is not exactly 0 or 1.

    Each further strategy runs only for the devices the one before left open.
    Results are one row per device and are written out between the rounds.
    """
    known = prepare(scores)
    settled = None
    for strategy in STRATEGIES:
        value = cut_lineage(strategy(known).select(KEY, (F.col("threshold") * SAFETY).alias("base")))
        degenerate = F.col("base").isNull() | F.col("base").isin(0.0, 1.0)
        good = value.filter(~degenerate)
        settled = good if settled is None else settled.unionByName(good)
        left = value.filter(degenerate).select(KEY)
        if left.isEmpty():
            return settled
        known = known.only(left)
    stats = known.stats.join(_order_statistics(known.ranks), KEY)
    simple = stats.select(KEY, F.least((F.col("p90") + F.col("std")) * SAFETY, F.col("p99")).alias("base"))
    return settled.unionByName(simple)


def final_threshold(scores: DataFrame) -> DataFrame:
    """The gated threshold of every device."""
    known = prepare(scores)
    stats = cut_lineage(profile(known).join(base_thresholds(known), KEY))
    return gate(stats, known)


def gate(stats: DataFrame, scores: DataFrame | ScoreSet) -> DataFrame:
    """Correct base thresholds that are implausibly high or low.

    ``stats`` holds :func:`profile` and ``base``.
    """
    n, med, p95, p99, sd, top = (F.col(c) for c in ("n", "median", "p95", "p99", "std", "max"))
    dense = F.abs(med - p95) < sd * 2
    df = needle_override(stats, "base", "_t1")
    t1 = F.col("_t1")
    thin_tail = (F.col("above_p95") / n < 0.01) & (F.col("above_p99") / n < 0.005)
    t2 = (
        F.when(t1 <= p99, t1)
        .when(dense, F.greatest(med + 2 * sd, p95))
        .when(thin_tail, p95)
        .otherwise(t1)
    )
    df = df.withColumn("_t2", t2)
    below = F.col("_t2") < p95
    far = F.abs(F.col("_t2") - p95) * 5 > F.abs(F.col("_t2") - med)
    low = df.filter(below).select(KEY, F.when(far, F.col("_t2")).otherwise(p95).alias("start"))
    raised = slow_increment(scores, low, 1.1).withColumnRenamed("raised", "_raised")
    df = df.join(raised, KEY, "left").withColumn("_t3", F.when(below, F.col("_raised")).otherwise(F.col("_t2")))
    flat = (F.abs(p95 - p99) < sd * 2) & (F.abs(top - p99) < sd)
    stream = df.filter(dense & ~flat).select(KEY, F.col("_t3").alias("start"))
    lifted = slow_increment(scores, stream, 1.2).withColumnRenamed("raised", "_lifted")
    t4 = F.when(~dense, F.col("_t3")).when(flat, top).otherwise(F.col("_lifted"))
    floor = F.greatest("p90", "rank90")
    return df.join(lifted, KEY, "left").select(KEY, F.least(F.greatest(t4, floor), top).alias("threshold"))

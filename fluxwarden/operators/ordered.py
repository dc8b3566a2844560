"""Ordered computations over keys that may hold a large share of all rows.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here
each key is cut into blocks of consecutive order values. The wide work happens
inside ``(key, block)``; only one summary row per block is ordered per key, and
the summary is joined back on ``(key, block)``, which is the partitioning the
rows already have. Block borders follow from the order value alone, so a
recomputed task finds the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_BITS = 16  # 65,536 consecutive order values per block
BLOCK = "_block"


def with_block(df: DataFrame, order: str, bits: int = BLOCK_BITS) -> DataFrame:
    return df.withColumn(BLOCK, F.shiftright(F.col(order).cast("long"), bits))


def attach(facts: DataFrame, stats: DataFrame, keys: list[str], how: str = "left", block: str = BLOCK) -> DataFrame:
    """Join per-key statistics to rows that carry a block column.

    The statistics are first spread over the blocks that occur, so the join key
    is ``(keys, block)`` and a hot key stays split.
    """
    spread = facts.select(*keys, block).distinct().join(stats, keys)
    return facts.join(spread, [*keys, block], how)


def running_max_before(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Maximum of ``value`` over all strictly earlier rows of the key."""
    rows = with_block(df, order, bits).withColumn("_v", value)
    summary = rows.groupBy(*keys, BLOCK).agg(F.max("_v").alias("_bmax"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, BLOCK, F.max("_bmax").over(earlier).alias("_carry"))
    local = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_local", F.max("_v").over(local))
        .join(carry, [*keys, BLOCK], "left")
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_v", "_local", "_carry", BLOCK)
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Inclusive running sum of ``value`` in the key's order."""
    rows = with_block(df, order, bits).withColumn("_v", value)
    summary = rows.groupBy(*keys, BLOCK).agg(F.sum("_v").alias("_bsum"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, BLOCK, F.sum("_bsum").over(earlier).alias("_carry"))
    local = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.sum("_v").over(local))
        .join(carry, [*keys, BLOCK], "left")
        .withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_v", "_local", "_carry", BLOCK)
    )


def preceding(
    df: DataFrame, keys: list[str], order: str, value: Column, k: int, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Array of the up to ``k`` non-null values just before each row, oldest first.

    Rows near the start of a block take what is missing from the tails of the
    blocks before it; ``k`` non-empty blocks hold at least ``k`` rows.
    """
    rows = with_block(df, order, bits).withColumn("_v", value)
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(order)
    tails = (
        rows.select(*keys, BLOCK, F.col(order).alias("_o"), "_v")
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(F.col("_o").desc())))
        .filter(F.col("_rn") <= k)
        .groupBy(*keys, BLOCK)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"]).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-k, -1)
    halo = tails.select(
        *keys, BLOCK, F.flatten(F.collect_list("_tail").over(before)).alias("_halo")
    ).withColumn("_halo", F.slice("_halo", F.greatest(F.size("_halo") - k + 1, F.lit(1)), F.lit(k)))
    joined = rows.withColumn("_near", F.collect_list("_v").over(in_block.rowsBetween(-k, -1))).join(
        halo, [*keys, BLOCK], "left"
    )
    whole = F.when(F.size("_near") >= k, F.col("_near")).otherwise(
        F.concat(F.coalesce("_halo", F.expr("array()").cast(joined.schema["_near"].dataType)), F.col("_near"))
    )
    return (
        joined.withColumn("_all", whole)
        .withColumn(out, F.slice("_all", F.greatest(F.size("_all") - k + 1, F.lit(1)), F.lit(k)))
        .drop("_v", "_near", "_halo", "_all", BLOCK)
    )


def previous(df: DataFrame, keys: list[str], order: list[str], block: Column, values: dict[str, str]) -> DataFrame:
    """The row before in the key's order, over blocks that ``block`` cuts in this order: ``values`` maps new columns to
    the columns they take from it."""
    rows = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    last = F.max_by(F.struct(*values.values()), F.struct(*order)).alias("_last")
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = rows.groupBy(*keys, BLOCK).agg(last).select(*keys, BLOCK, F.lag("_last").over(by_block).alias("_carry"))
    local = rows.withColumns({"_here": F.lag(F.struct(*values.values())).over(inside)})
    joined = local.join(carry, [*keys, BLOCK], "left").withColumn("_row", F.coalesce("_here", "_carry"))
    return joined.withColumns({new: F.col("_row")[old] for new, old in values.items()}).drop("_here", "_carry", "_row", BLOCK)


def latest(df: DataFrame, keys: list[str], order: str, k: int, bits: int = BLOCK_BITS) -> DataFrame:
    """The ``k`` newest rows of each key, narrowed per block before per key."""
    rows = with_block(df, order, bits)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(F.col(order).desc())
    overall = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    narrowed = rows.withColumn("_rn", F.row_number().over(inside)).filter(F.col("_rn") <= k)
    # A block keeps at most k rows; blocks older than the k-th newest row cannot contribute.
    counts = narrowed.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    useful = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).filter(F.col("_newer") < k)
    return (
        narrowed.join(useful.select(*keys, BLOCK), [*keys, BLOCK], "left_semi")
        .withColumn("_rn", F.row_number().over(overall))
        .filter(F.col("_rn") <= k)
        .drop("_rn", BLOCK)
    )

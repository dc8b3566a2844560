"""Country lookup: an as-of join of addresses with sorted address ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUCKET_SHIFT = 16  # ranges are cut at /16 borders: at most 65,536 pieces more than ranges
UNKNOWN = "Unknown"


def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges without overlap that answer "greatest start not above the address".

    Of several ranges with one start the greatest wins; a range ends where the
    next one begins, even if it claimed more.
    """
    by_start = ranges.groupBy("ip_start").agg(F.max(F.struct("ip_end", "country")).alias("_r"))
    rows = by_start.select("ip_start", "_r.ip_end", "_r.country", F.shiftright("ip_start", 24).alias("_octet"))
    inside = Window.partitionBy("_octet").orderBy("ip_start")
    first = rows.groupBy("_octet").agg(F.min("ip_start").alias("_first"))
    # One row per leading octet: 256 rows at most.
    after = Window.partitionBy(F.lit(0)).orderBy("_octet")
    following = first.select("_octet", F.lead("_first").over(after).alias("_following"))
    return (
        rows.withColumn("_next", F.lead("ip_start").over(inside))
        .join(following, "_octet")
        .withColumn("ip_end", F.least("ip_end", F.coalesce("_next", "_following") - 1))
        .filter(F.col("ip_end") >= F.col("ip_start"))
        .select("ip_start", "ip_end", "country")
    )


def bucketed_ranges(ranges: DataFrame) -> DataFrame:
    """One row per /16 bucket a range touches, as an equi-join key."""
    return disjoint_ranges(ranges).withColumn(
        "_bucket",
        F.explode(F.sequence(F.shiftright("ip_start", BUCKET_SHIFT), F.shiftright("ip_end", BUCKET_SHIFT))),
    )


def with_country(rows: DataFrame, ranges: DataFrame, ip: str = "remote_ip") -> DataFrame:
    """Add ``country`` by the address column ``ip``; no match gives Unknown.

    The ranges of a bucket are gathered into one array (at most 65,536 disjoint
    ranges fit into a /16), so the join adds no rows and needs no second pass.
    """
    pieces = (
        bucketed_ranges(ranges)
        .groupBy("_bucket")
        .agg(F.collect_list(F.struct("ip_start", "ip_end", "country")).alias("_ranges"))
    )
    keyed = rows.withColumn("_bucket", F.shiftright(F.col(ip).cast("long"), BUCKET_SHIFT))
    joined = keyed.join(pieces, "_bucket", "left")
    hit = F.filter("_ranges", lambda r: F.col(ip).between(r["ip_start"], r["ip_end"]))
    return joined.withColumn(
        "country", F.coalesce(F.try_element_at(hit, F.lit(1))["country"], F.lit(UNKNOWN))
    ).drop("_bucket", "_ranges")

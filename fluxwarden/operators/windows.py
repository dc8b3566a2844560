"""Sliding 60 s windows every 20 s, anchored at a device's first packet.

The rows of a device are ordered by (window, packet): rows repeat
in up to three overlapping windows, and "the previous row" of the first row of
a window is the last row of the window before. None of this needs the repeated
rows to be shuffled:

* inside a window the previous row is the device's previous packet;
* across windows only one first and one last row per window matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from . import ordered
from .packets import with_endpoints, with_flow, with_locality

WINDOW_US = 60_000_000
STRIDE_US = 20_000_000
KEYS = ["capture_id", "device_mac"]
WINDOW_KEYS = [*KEYS, "windowid"]
IAT_CAP_US = 3_600_000_000.0


def anchored(packets: DataFrame, bits: int = ordered.BLOCK_BITS, previous: bool = True) -> DataFrame:
    """Packets with the device's first and last time in the capture and,
    optionally, the previous packet's time and flow.

    One shuffle of the packets by (capture, device, block); the per-block
    summary carries everything that crosses a block border.
    """
    rows = ordered.with_block(packets, "seq", bits)
    block = ordered.BLOCK
    aggs = [F.min("ts_us").alias("_min"), F.max("ts_us").alias("_max")]
    if previous:
        aggs += [F.max_by(c, "seq").alias(f"_last_{c}") for c in ("ts_us", "flow_a", "flow_b")]
    summary = rows.groupBy(*KEYS, block).agg(*aggs)
    whole = Window.partitionBy(*KEYS)
    by_block = whole.orderBy(block)
    carried = [F.min("_min").over(whole).alias("first_ts"), F.max("_max").over(whole).alias("last_ts")]
    if previous:
        carried += [F.lag(f"_last_{c}").over(by_block).alias(f"_carry_{c}") for c in ("ts_us", "flow_a", "flow_b")]
    borders = summary.select(*KEYS, block, *carried)
    if previous:
        inside = Window.partitionBy(*KEYS, block).orderBy("seq")
        rows = rows.withColumns({f"_lag_{c}": F.lag(c).over(inside) for c in ("ts_us", "flow_a", "flow_b")})
    joined = rows.join(borders, [*KEYS, block])
    if previous:
        joined = joined.withColumns(
            {
                f"prev_{c}": F.coalesce(f"_lag_{c}", f"_carry_{c}")
                for c in ("ts_us", "flow_a", "flow_b")
            }
        )
    return joined.drop(block, *[c for c in joined.columns if c.startswith(("_lag_", "_carry_"))])


def window_index(partial: bool) -> tuple[Column, Column]:
    """Lowest and highest window number of a packet."""
    offset = F.col("ts_us") - F.col("first_ts")
    newest = F.floor(offset / F.lit(STRIDE_US))
    low = F.greatest(newest - F.lit(WINDOW_US // STRIDE_US - 1), F.lit(0))
    if partial:
        return low, newest
    last_complete = F.floor((F.col("last_ts") - F.col("first_ts") - F.lit(WINDOW_US)) / F.lit(STRIDE_US))
    return low, F.least(newest, last_complete)


def explode_windows(rows: DataFrame, partial: bool = False) -> DataFrame:
    """Repeat every anchored packet once per window that holds it.

    With ``partial`` windows may reach beyond the last packet.
    """
    low, high = window_index(partial)
    return (
        rows.withColumns({"_low": low, "_high": high})
        .filter(F.col("_high") >= F.col("_low"))
        .withColumn("_k", F.explode(F.sequence("_low", "_high")))
        .withColumn("windowid", F.col("first_ts") + F.col("_k") * STRIDE_US)
        .drop("_low", "_high")
    )


def sliding_windows(packets: DataFrame, partial: bool = False, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    return explode_windows(anchored(packets, bits, previous=False), partial).drop("_k", "first_ts", "last_ts")


def only_enough(rows: DataFrame) -> DataFrame:
    """Leave out devices whose packets of a capture do not span a window."""
    return rows.filter(F.col("last_ts") - F.col("first_ts") > WINDOW_US)


def _first_in_window() -> Column:
    return F.col("prev_ts_us").isNull() | (F.col("prev_ts_us") < F.col("windowid"))


def window_edges(exploded: DataFrame) -> DataFrame:
    """First and last row of every window and the last row of the window before,
    which may belong to the device's previous capture."""
    edges = exploded.groupBy(*WINDOW_KEYS).agg(
        F.min("seq").alias("seq"),
        *[F.min_by(c, "seq").alias(f"first_{c}") for c in ("ts_us", "flow_a", "flow_b")],
        *[F.max_by(c, "seq").alias(f"last_{c}") for c in ("ts_us", "flow_a", "flow_b")],
    )
    return with_carry(edges)


CAPTURES_BITS = 6
ARRIVAL_DIGITS = 7


def capture_block(rows: DataFrame) -> Column:
    """Blocks of captures in the order of their ids: 64 numbers, or what shares the beginning of a text, which for the
    ids of files is what arrived within three hours."""
    if rows.schema["capture_id"].dataType.typeName() == "string":
        return F.substring("capture_id", 1, ARRIVAL_DIGITS)
    return F.shiftright(F.col("capture_id").cast("long"), CAPTURES_BITS)


def with_carry(edges: DataFrame) -> DataFrame:
    """The last row of the window before, of one row per window; the windows of a device are ordered in blocks of
    captures."""
    values = {f"carry_{c}": f"last_{c}" for c in ("ts_us", "flow_a", "flow_b")}
    return ordered.previous(edges, ["device_mac"], ["capture_id", "windowid"], capture_block(edges), values)


def _flow_differs(a: str, b: str) -> Column:
    return (F.col(f"{a}_flow_a") != F.col(f"{b}_flow_a")) | (F.col(f"{a}_flow_b") != F.col(f"{b}_flow_b"))


def window_row_changes(packets: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Flow change and inter-arrival time of every row of every window.

    Rows inside a window follow from the packet alone. The first rows come from
    the window summary, so the repeated rows are never joined or sorted.
    """
    exploded = explode_windows(anchored(with_flow(packets), bits))
    inner = exploded.filter(~_first_in_window()).select(
        *WINDOW_KEYS,
        "seq",
        F.when((F.col("flow_a") != F.col("prev_flow_a")) | (F.col("flow_b") != F.col("prev_flow_b")), 1)
        .otherwise(0)
        .alias("flow_change"),
        (F.col("ts_us") - F.col("prev_ts_us")).alias("iat_us"),
    )
    first = window_edges(exploded).select(
        *WINDOW_KEYS,
        "seq",
        F.when(F.col("carry_flow_a").isNull() | _flow_differs("first", "carry"), 1).otherwise(0).alias("flow_change"),
        F.greatest(F.coalesce(F.col("first_ts_us") - F.col("carry_ts_us"), F.lit(0)), F.lit(0)).alias("iat_us"),
    )
    return inner.unionByName(first).withColumn("iat_scaled", S.log_cap(F.col("iat_us"), IAT_CAP_US))


__all__ = [
    "anchored", "explode_windows", "sliding_windows", "only_enough", "window_edges", "with_carry",
    "window_row_changes", "with_endpoints", "with_flow", "with_locality",
]

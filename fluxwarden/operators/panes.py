"""Sliding windows from panes: 20 s partial aggregates, three to a window.

A packet is aggregated once, in its pane; windows are put together from panes, so packets are never repeated.

* Sums and extremes of a window are those of its panes.
* Distinct values: a pane keeps its different values, each as one number or text; a window joins three such sets.
* Medians: a pane keeps its values as a sorted list; a window joins three sorted lists.
* The row before a window's first row: a pane keeps its first and last row apart.

A window belongs to its first pane that has a packet, which finds the other two as the next rows in order. Panes are
ordered in groups of ``GROUP`` with the panes at the borders copied, so a task holds some minutes of a device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import KEYS, STRIDE_US, WINDOW_US

GROUP = 64
SPAN = WINDOW_US // STRIDE_US


def with_pane(rows: DataFrame) -> DataFrame:
    """Pane number of anchored packets."""
    return rows.withColumn("pane", F.floor((F.col("ts_us") - F.col("first_ts")) / F.lit(STRIDE_US)))


#: Kinds of distinct values, and their types as one value each.
DISTINCTS = {"flows": "string", "src_ips": "bigint", "dst_ips": "bigint", "connections": "bigint"}


def value_sets() -> list[Column]:
    """The different values of a pane. Addresses have 32 bits, so a pair of them is one number; a flow is a text."""
    values = {
        "flows": F.concat(F.hex("flow_a"), F.lit("/"), F.hex("flow_b")),
        "src_ips": F.col("src_ip").cast("long"),
        "dst_ips": F.col("dst_ip").cast("long"),
        "connections": F.shiftleft(F.least("src_ip", "dst_ip").cast("long"), 32).bitwiseOR(F.greatest("src_ip", "dst_ip").cast("long")),
    }
    return [F.collect_set(values[name]).alias(name) for name in DISTINCTS]


def aggregate(rows: DataFrame, aggregates: list[Column]) -> DataFrame:
    """One row per pane with a packet: the aggregates, value sets and the ends of the device's time in the capture."""
    ends = [F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]
    return rows.groupBy(*KEYS, "pane").agg(*aggregates, *ends, *value_sets())


def windows_of(panes: DataFrame) -> DataFrame:
    """One row per window with a packet: ``_k`` (its number), ``windowid`` and the structs ``p0`` (the first pane with a
    packet), ``p1`` and ``p2`` (the next ones inside the window, else null)."""
    fields = [c for c in panes.columns if c not in KEYS]
    group, place = F.floor(F.col("pane") / GROUP), F.col("pane") % GROUP
    halo = F.array_compact(F.array(
        group, F.when(place < SPAN - 1, group - 1), F.when(place >= GROUP - (SPAN - 1), group + 1)
    ))
    spread = panes.select(*KEYS, F.struct(*fields).alias("p0"), F.col("pane").alias("_pane"), group.alias("_own"), F.explode(halo).alias("_group"))
    order = Window.partitionBy(*KEYS, "_group").orderBy("_pane")
    near = spread.select(
        *KEYS, "p0", "_pane", "_own", "_group", F.lag("_pane").over(order).alias("_before"),
        F.lead("p0", 1).over(order).alias("p1"), F.lead("p0", 2).over(order).alias("p2"),
    ).filter("_own = _group")
    last = F.floor((F.col("p0.last_ts") - F.col("p0.first_ts") - F.lit(WINDOW_US)) / F.lit(STRIDE_US))
    low = F.greatest(F.lit(0).cast("long"), F.col("_pane") - (SPAN - 1), F.coalesce(F.col("_before") + 1, F.lit(0)))
    high = F.least(F.col("_pane"), last)
    inside = lambda p: F.when(F.col(p)["pane"] < F.col("_k") + SPAN, F.col(p))
    return (
        near.withColumns({"_low": low, "_high": high})
        .filter("_high >= _low")
        .withColumn("_k", F.explode(F.sequence("_low", "_high")))
        .withColumn("windowid", F.col("p0.first_ts") + F.col("_k") * STRIDE_US)
        .select(*KEYS, "windowid", "_k", "p0", inside("p1").alias("p1"), inside("p2").alias("p2"))
    )


def sums(values: dict[str, Column]) -> Column:
    """Sums of a pane as one array, in the order of ``values``: few columns keep the plan of the windows small."""
    return F.array(*[F.sum(c).cast("double") for c in values.values()]).alias("sums")


def total(count: int) -> Column:
    """Sums over the panes of a window, an array of ``count`` numbers."""
    none = F.array_repeat(F.lit(0.0), count)
    add = lambda a, b: a + b
    return F.zip_with(F.zip_with(F.col("p0")["sums"], F.coalesce(F.col("p1")["sums"], none), add), F.coalesce(F.col("p2")["sums"], none), add)


def named(values: dict[str, Column]) -> list[Column]:
    """The numbers of an array ``sums`` as columns."""
    return [F.get("sums", F.lit(i)).alias(name) for i, name in enumerate(values)]


def least(name: str) -> Column:
    return F.least(*[F.col(p)[name] for p in ("p0", "p1", "p2")])


def greatest(name: str) -> Column:
    return F.greatest(*[F.col(p)[name] for p in ("p0", "p1", "p2")])


def joined(*lists: Column) -> Column:
    return F.concat(*[F.coalesce(x, F.array().cast("array<double>")) for x in lists])


def distinct(name: str) -> Column:
    """Different values of a window."""
    none = F.array().cast(f"array<{DISTINCTS[name]}>")
    sets = [F.coalesce(F.col(p)[name], none) for p in ("p0", "p1", "p2")]
    return F.size(F.array_distinct(F.concat(*sets)))


def median(values: Column) -> Column:
    """Median of a list with at least one value."""
    s = F.sort_array(values)
    size = F.size(s)
    return (F.element_at(s, F.floor((size + 1) / 2).cast("int")) + F.element_at(s, (F.floor(size / 2) + 1).cast("int"))) / 2

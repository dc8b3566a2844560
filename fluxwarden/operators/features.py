"""The 45 behaviour features of a (capture, device, window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from . import ordered, panes as PN
from .packets import PROTO_TCP, with_endpoints, with_flow, with_locality
from .windows import IAT_CAP_US, STRIDE_US, WINDOW_KEYS, _flow_differs, anchored, only_enough, with_carry

# Names and order of the feature vector.
FEATURES = [
    "packet_count_scaled", "out_pkts_scaled", "in_pkts_scaled", "packets_per_second_scaled",
    "total_bytes_scaled", "out_bytes_scaled", "in_bytes_scaled", "bytes_per_second_scaled",
    "byte_balance05", "flow_count_scaled", "src_ip_count_scaled", "dst_ip_count_scaled",
    "connection_count_scaled", "flow_change_mean",
    "iat_scaled_min", "iat_scaled_max", "iat_scaled_median", "iat_scaled_mean",
    "payload_len_scaled_min", "payload_len_scaled_max", "payload_len_scaled_median", "payload_len_scaled_mean",
    "src_port_system_mean", "src_port_user_mean", "src_port_dynamic_mean",
    "dst_port_system_mean", "dst_port_user_mean", "dst_port_dynamic_mean",
    "ip_ttl_norm_min", "ip_ttl_norm_max", "ip_ttl_norm_median", "ip_ttl_norm_mean",
    "tcp_flag_cwr_mean", "tcp_flag_ece_mean", "tcp_flag_urg_mean", "tcp_flag_ack_mean",
    "tcp_flag_psh_mean", "tcp_flag_rst_mean", "tcp_flag_syn_mean", "tcp_flag_fin_mean",
    "is_outgoing_mean", "is_tcp_mean", "is_global_mean", "is_multicast_mean", "is_broadcast_mean",
]

# Caps of the scaled features.
PACKETS_CAP = 32.0
PACKET_RATE_CAP = 10_000.0
BYTES_CAP = 1_500.0
BYTE_RATE_CAP = 10_000_000.0
PAYLOAD_CAP = 65_535.0


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def packet_measures(packets: DataFrame) -> DataFrame:
    """Per-packet inputs of the features, computed once before windows repeat rows."""
    df = with_locality(with_endpoints(with_flow(packets)))
    is_tcp = F.col("proto") == PROTO_TCP
    measures = {
        "payload_len_scaled": S.log_cap(S.payload_length(F.col("packet_length"), is_tcp), PAYLOAD_CAP),
        **S.port_classes(F.col("src_port"), "src"),
        **S.port_classes(F.col("dst_port"), "dst"),
        "ip_ttl_norm": S.unit_scale(F.col("ip_ttl")),
        **S.tcp_flag_columns(F.col("tcp_flags"), is_tcp),
        "is_tcp": _one(is_tcp),
        "is_out": _one(F.col("is_outgoing")),
        **{c: _one(F.col(c)) for c in ("is_global", "is_multicast", "is_broadcast")},
    }
    keep = ["capture_id", "device_mac", "seq", "ts_us", "packet_length", "src_ip", "dst_ip", "flow_a", "flow_b"]
    return df.select(*keep, *[c.alias(name) for name, c in measures.items()])


MEAN_FLAGS = [
    f"{side}_port_{name}" for side in ("src", "dst") for name in ("system", "user", "dynamic")
] + list(S.TCP_FLAG_BITS) + ["is_tcp", "is_global", "is_multicast", "is_broadcast"]


def _native_sums() -> dict[str, Column]:
    length = F.col("packet_length")
    return {
        "n": F.lit(1), "n_out": F.col("is_out"), "bytes": length, "bytes_out": F.when(F.col("is_out") == 1, length).otherwise(0),
    }


def _times() -> list[Column]:
    return [F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us")]


def _spans() -> list[Column]:
    """Duration and distinct counts of a window."""
    seconds = (PN.greatest("last_ts_us") - PN.least("first_ts_us")) / F.lit(1e6)
    return [seconds.alias("seconds"), *[PN.distinct(c).alias(c) for c in PN.DISTINCTS]]


def window_distincts(packets: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Packets and exact distinct flows, addresses and unordered address pairs per window."""
    rows = PN.with_pane(anchored(with_flow(with_endpoints(packets)), bits, previous=False))
    values = {"packets": F.lit(1)}
    windows = PN.windows_of(PN.aggregate(rows, [PN.sums(values)]))
    found = windows.select(*WINDOW_KEYS, PN.total(1).alias("sums"), *[PN.distinct(c).alias(c) for c in PN.DISTINCTS])
    return found.select(*WINDOW_KEYS, *PN.named(values), *PN.DISTINCTS)


def _native_columns() -> dict[str, Column]:
    n, n_out, b, b_out = (F.col(c) for c in ("n", "n_out", "bytes", "bytes_out"))
    single = n == 1
    m = F.when(single, 2).otherwise(n).cast("double")

    def spread(column: str) -> Column:
        return S.log_cap(F.when(single, 2).otherwise(F.col(column)), m, floor=1.0)

    return {
        "packet_count_scaled": S.log_cap(n, PACKETS_CAP),
        "out_pkts_scaled": S.log_cap(n_out, PACKETS_CAP),
        "in_pkts_scaled": S.log_cap(n - n_out, PACKETS_CAP),
        "packets_per_second_scaled": S.log_cap(S.safe_div(n, F.col("seconds")), PACKET_RATE_CAP),
        "total_bytes_scaled": S.log_cap(b, BYTES_CAP),
        "out_bytes_scaled": S.log_cap(b_out, BYTES_CAP),
        "in_bytes_scaled": S.log_cap(b - b_out, BYTES_CAP),
        "bytes_per_second_scaled": S.log_cap(S.safe_div(b, F.col("seconds")), BYTE_RATE_CAP),
        "byte_balance05": S.balance(b_out, b - b_out),
        "flow_count_scaled": spread("flows"),
        "src_ip_count_scaled": spread("src_ips"),
        "dst_ip_count_scaled": spread("dst_ips"),
        "connection_count_scaled": spread("connections"),
    }


def window_native(packets: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """The 13 features that need no packet order."""
    rows = PN.with_pane(anchored(packet_measures(packets), bits, previous=False))
    values = _native_sums()
    windows = PN.windows_of(PN.aggregate(rows, [PN.sums(values), *_times()])).select(*WINDOW_KEYS, PN.total(len(values)).alias("sums"), *_spans())
    columns = _native_columns()
    inputs = windows.select(*WINDOW_KEYS, "seconds", *PN.DISTINCTS, *PN.named(values))
    return inputs.select(*WINDOW_KEYS, *[c.alias(name) for name, c in columns.items()])


LISTED = ["payload_len_scaled", "ip_ttl_norm"]
EDGE = ["flow_a", "flow_b"]


def _pane_sums() -> dict[str, Column]:
    """What is added up over the packets of a pane, and over the panes of a window. The pane's first packet is kept apart
    from the changes: whether its row before lies in the window depends on the window."""
    changes = F.when(F.col("pane_first"), 0).otherwise(F.col("changed"))
    return {**_native_sums(), "changes": changes, **{f"{c}_sum": F.col(c) for c in LISTED}, **{c: F.col(c) for c in MEAN_FLAGS}}


def _pane_aggregates() -> list[Column]:
    iat = F.when(~F.col("pane_first"), F.col("iat_scaled"))
    first = F.struct("ts_us", *EDGE, "iat_scaled", "changed")
    return [
        PN.sums(_pane_sums()), *_times(), F.min_by(first, "seq").alias("first"), F.max_by(F.struct("ts_us", *EDGE), "seq").alias("last"),
        F.sort_array(F.collect_list(iat)).alias("iats"), *[F.sort_array(F.collect_list(c)).alias(c) for c in LISTED],
    ]


def window_features(packets: DataFrame, bits: int = ordered.BLOCK_BITS, carry: DataFrame | None = None) -> DataFrame:
    """All 45 features per (capture, device, window).

    ``carry`` may hold the last row ``(device_mac, carry_ts_us, carry_flow_a,
    carry_flow_b)`` of what was processed before, as a stream needs it; the
    result then also has the last row of every window.

    The first row of a window has, in general, an inter-arrival time of 0: the
    window before ends later. Only where the first 40 s of a window are empty is
    it the time since the previous packet. The very first row of a capture
    depends on the device's previous capture and is added after aggregation, so
    one pass over the packets is enough.
    """
    rows = PN.with_pane(only_enough(anchored(packet_measures(packets), bits)))
    start = F.col("first_ts") + F.col("pane") * STRIDE_US
    changed = (F.col("flow_a") != F.col("prev_flow_a")) | (F.col("flow_b") != F.col("prev_flow_b"))
    rows = rows.withColumns(
        {
            "pane_first": F.col("prev_ts_us").isNull() | (F.col("prev_ts_us") < start),
            "iat_scaled": S.log_cap(F.col("ts_us") - F.col("prev_ts_us"), IAT_CAP_US),
            "changed": _one(F.coalesce(changed, F.lit(False))),
        }
    )
    windows = PN.windows_of(PN.aggregate(rows, _pane_aggregates()))
    values = _pane_sums()
    opening = F.col("_k") == 0
    p0, later = F.col("p0"), [F.col("p1"), F.col("p2")]
    overlap = p0["first"]["ts_us"] < F.col("windowid") + 2 * STRIDE_US
    # the opening row of a capture waits for the carry
    first_iat = F.when(opening, F.lit(None).cast("double")).when(overlap, 0.0).otherwise(p0["first"]["iat_scaled"])
    iats = PN.joined(p0["iats"], F.array_compact(F.array(first_iat, *[p["first"]["iat_scaled"] for p in later])), *[p["iats"] for p in later])
    changes = sum((F.coalesce(p["first"]["changed"], F.lit(0)) for p in later), F.lit(0))
    last = F.coalesce(*[F.col(p)["last"] for p in ("p2", "p1", "p0")])
    summary = windows.select(
        *WINDOW_KEYS, "_k", PN.total(len(values)).alias("sums"), *_spans(), changes.alias("first_changes"), iats.alias("iats"),
        p0["first"].alias("first"), last.alias("last"), *[PN.joined(p0[c], *[p[c] for p in later]).alias(c) for c in LISTED],
    )
    n = F.col("n")
    order = [c for name in LISTED for c in (F.array_min(name).alias(f"{name}_min"), F.array_max(name).alias(f"{name}_max"), PN.median(F.col(name)).alias(f"{name}_median"))]
    summary = summary.select(
        *WINDOW_KEYS, "_k", "seconds", *PN.DISTINCTS, "first_changes", *PN.named(values), *order,
        *[F.col(end)[c].alias(f"{end}_{c}") for end in ("first", "last") for c in ("ts_us", *EDGE)],
        F.when(opening, F.col("iats")).alias("opening_iats"),  # 60 s of one device, once a capture
        F.array_min("iats").alias("iat_min"), F.array_max("iats").alias("iat_max"),
        F.aggregate("iats", F.lit(0.0), lambda a, x: a + x).alias("iat_sum"), F.when(~opening, PN.median(F.col("iats"))).alias("iat_median"),
    )
    summary = with_carry(summary)
    if carry is not None:
        old = carry.select("device_mac", *[F.col(f"carry_{c}").alias(f"_old_{c}") for c in ("ts_us", "flow_a", "flow_b")])
        summary = summary.join(old, "device_mac", "left").withColumns(
            {f"carry_{c}": F.coalesce(f"carry_{c}", f"_old_{c}") for c in ("ts_us", "flow_a", "flow_b")}
        )
    waited = F.greatest(F.coalesce(F.col("first_ts_us") - F.col("carry_ts_us"), F.lit(0)), F.lit(0))
    summary = summary.withColumn("first_iat", S.log_cap(waited, IAT_CAP_US)).withColumn(
        "first_change", _one(F.col("carry_flow_a").isNull() | _flow_differs("first", "carry"))
    )
    extra = F.when(opening, F.col("first_iat"))
    columns = {
        **_native_columns(),
        "flow_change_mean": (F.col("changes") + F.col("first_changes") + F.col("first_change")) / n,
        "is_outgoing_mean": F.col("n_out") / n,
        **{f"{c}_mean": F.col(f"{c}_sum") / n for c in LISTED},
        **{f"{c}_mean": F.col(c) / n for c in MEAN_FLAGS},
        "iat_scaled_min": F.least("iat_min", extra),
        "iat_scaled_max": F.greatest("iat_max", extra),
        "iat_scaled_median": F.when(opening, PN.median(F.concat("opening_iats", F.array("first_iat")))).otherwise(F.col("iat_median")),
        "iat_scaled_mean": (F.coalesce("iat_sum", F.lit(0.0)) + F.coalesce(extra, F.lit(0.0))) / F.col("n"),
    }
    final = [columns[name].alias(name) if name in columns else F.col(name) for name in FEATURES]
    edge = ["last_ts_us", "last_flow_a", "last_flow_b"] if carry is not None else []
    return summary.select(*WINDOW_KEYS, *final, *edge)


def feature_vector(features: DataFrame, name: str = "vector") -> DataFrame:
    return features.withColumn(name, F.array(*[F.col(c).cast("double") for c in FEATURES])).drop(*FEATURES)


CARRY_SCHEMA = "device_mac string, carry_ts_us long, carry_flow_a long, carry_flow_b long"


def next_carry(features: DataFrame) -> DataFrame:
    """Last row of each device's last window, for the captures to come."""
    order = F.struct("capture_id", "windowid")
    return features.groupBy("device_mac").agg(
        *[F.max_by(f"last_{c}", order).alias(f"carry_{c}") for c in ("ts_us", "flow_a", "flow_b")]
    )

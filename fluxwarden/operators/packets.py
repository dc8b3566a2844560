"""From captured frames to packets attributed to registered devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from . import ordered

# Ethernet types and IP protocol numbers.
ETH_IPV4 = 0x0800
ETH_VLAN = 0x8100
ETH_VLAN_OUTER = 0x88A8
PROTO_TCP = 6
PROTO_UDP = 17

MIN_FRAME_BYTES = 14


def _bytes(frame: Column, offset: Column | int, count: int) -> Column:
    start = offset + 1 if isinstance(offset, int) else offset + F.lit(1)
    return F.substring(frame, F.lit(start) if isinstance(start, int) else start, F.lit(count))


def _uint(frame: Column, offset: Column | int, count: int) -> Column:
    return S.unsigned(_bytes(frame, offset, count))


def decode_frames(frames: DataFrame) -> DataFrame:
    """Decode Ethernet, IPv4, TCP and UDP headers of a BINARY ``frame`` column.

    Up to two VLAN tags shift the offsets. Ports stay null where the transport
    header is missing: later fragments, truncated headers, other protocols.
    """
    frame = F.col("frame")
    outer = _uint(frame, 12, 2)
    df = frames.withColumn("frame_len", F.length(frame)).withColumn("_t0", outer)
    df = df.withColumn(
        "_shift",
        F.when(
            F.col("_t0").isin(ETH_VLAN, ETH_VLAN_OUTER),
            F.when(_uint(frame, 16, 2).isin(ETH_VLAN, ETH_VLAN_OUTER), 8).otherwise(4),
        ).otherwise(0),
    )
    df = df.withColumn("eth_type", F.when(F.col("frame_len") >= 14 + F.col("_shift"), _uint(frame, F.col("_shift") + 12, 2)))
    df = df.withColumn("_ip", F.col("_shift") + 14)
    has_ip = (F.col("eth_type") == ETH_IPV4) & (F.col("frame_len") >= F.col("_ip") + 20)
    df = df.withColumn("_ihl", F.when(has_ip, _uint(frame, F.col("_ip"), 1).bitwiseAND(F.lit(15)) * 4).cast("int"))
    df = df.withColumn("_ihl", F.when(F.col("_ihl") >= 20, F.col("_ihl")))
    ip_ok = F.col("_ihl").isNotNull()

    def ip_field(offset: int, count: int) -> Column:
        return F.when(ip_ok, _uint(frame, F.col("_ip") + offset, count))

    df = df.select(
        "*",
        S.mac_from_bytes(_bytes(frame, 0, 6)).alias("dst_mac"),
        S.mac_from_bytes(_bytes(frame, 6, 6)).alias("src_mac"),
        ip_field(2, 2).alias("_ip_len"),
        ip_field(6, 2).bitwiseAND(F.lit(0x1FFF)).alias("_fragment"),
        ip_field(8, 1).alias("ip_ttl"),
        ip_field(9, 1).alias("proto"),
        ip_field(12, 4).alias("src_ip"),
        ip_field(16, 4).alias("dst_ip"),
    )
    df = df.withColumn("_l4", (F.col("_ip") + F.col("_ihl")).cast("int"))
    # A total length of 0 means segmentation offload: everything captured belongs to the packet.
    ip_end = F.when(F.col("_ip_len") > 0, F.least(F.col("_ip") + F.col("_ip_len"), F.col("frame_len"))).otherwise(
        F.col("frame_len")
    )
    df = df.withColumn("_l4_len", ip_end - F.col("_l4"))
    first = F.col("_fragment") == 0
    is_tcp = F.col("proto") == PROTO_TCP
    tcp_ok = first & is_tcp & (F.col("_l4_len") >= 20) & (F.shiftright(_uint(frame, F.col("_l4") + 12, 1), 4) >= 5)
    udp_ok = first & (F.col("proto") == PROTO_UDP) & (F.col("_l4_len") >= 8)
    has_ports = tcp_ok | udp_ok
    df = df.withColumn("_tcp", tcp_ok).withColumn("_ports", has_ports)
    df = df.select(
        "*",
        F.when(F.col("_ports"), _uint(frame, F.col("_l4"), 2)).alias("src_port"),
        F.when(F.col("_ports"), _uint(frame, F.col("_l4") + 2, 2)).alias("dst_port"),
        F.when(F.col("_tcp"), _uint(frame, F.col("_l4") + 13, 1)).alias("tcp_flags"),
    )
    internal = [c for c in df.columns if c.startswith("_")]
    return df.drop("frame", *internal)


def monotone_filter(frames: DataFrame, keys: list[str], bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Mark frames older than the newest earlier frame of the same capture.

    Frames below the minimum size do not move the clock; late frames cannot,
    because they are below the running maximum.
    """
    clock = F.when(F.col("frame_len") >= MIN_FRAME_BYTES, F.col("ts_us"))
    return (
        ordered.running_max_before(frames, keys, "seq", clock, "_newest", bits)
        .withColumn("in_order", F.coalesce(F.col("ts_us") >= F.col("_newest"), F.lit(True)))
        .drop("_newest")
    )


def registry_flags(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """Membership of both MACs in the device registry as ``src_known``, ``dst_known``."""
    known = registry.select("device_mac").distinct()
    src = known.select(F.col("device_mac").alias("src_mac"), F.lit(True).alias("src_known"))
    dst = known.select(F.col("device_mac").alias("dst_mac"), F.lit(True).alias("dst_known"))
    df = frames.join(src, "src_mac", "left")
    df = df.join(dst, "dst_mac", "left")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("src_known", "dst_known")})


def disposition(frames: DataFrame) -> DataFrame:
    """One label per frame; the first failing check wins.

    Needs ``frame_len, in_order, eth_type, proto, src_known, dst_known`` and,
    where frames were decoded, ``src_port``.
    """
    no_ports = F.col("src_port").isNull() if "src_port" in frames.columns else F.lit(False)
    no_ip = F.col("proto").isNull()
    label = (
        F.when(F.col("frame_len") < MIN_FRAME_BYTES, "too_short")
        .when(~F.col("in_order"), "out_of_order")
        .when(F.col("eth_type").isNull(), "bad_ethernet")
        .when(F.col("eth_type") != ETH_IPV4, "not_ipv4")
        .when(no_ip, "malformed")
        .when(~F.col("proto").isin(PROTO_TCP, PROTO_UDP), "not_tcp_udp")
        .when(no_ports, "malformed")
        .when(~(F.col("src_known") | F.col("dst_known")), "unknown_device")
        .otherwise("accepted")
    )
    return frames.withColumn("disposition", label)


# Dispositions that count as faulty frames; an unknown device is not a fault.
FAULTS = ["too_short", "out_of_order", "bad_ethernet", "not_ipv4", "not_tcp_udp", "malformed"]


def assign_device(frames: DataFrame) -> DataFrame:
    """Direction and owning device; the source wins when both ends are registered."""
    return frames.withColumn("is_outgoing", F.when(F.col("src_known"), True).when(F.col("dst_known"), False)).withColumn(
        "device_mac", F.when(F.col("src_known"), F.col("src_mac")).when(F.col("dst_known"), F.col("dst_mac"))
    )


def orient(frames: DataFrame) -> DataFrame:
    """Accepted frames as packets with device and remote side."""
    out = F.col("is_outgoing")
    return frames.withColumns(
        {
            "device_ip": F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "remote_ip": F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")),
            "device_port": F.when(out, F.col("src_port")).otherwise(F.col("dst_port")),
            "remote_port": F.when(out, F.col("dst_port")).otherwise(F.col("src_port")),
        }
    )


PACKET_COLUMNS = [
    "capture_id", "seq", "ts_us", "device_mac", "packet_length", "proto", "is_outgoing",
    "device_ip", "remote_ip", "device_port", "remote_port", "ip_ttl", "tcp_flags",
]


def packets_from_frames(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw frames ``(capture_id, seq, ts_us, frame)`` to attributed packets."""
    labelled = label_frames(frames, registry)
    kept = orient(assign_device(labelled.filter(F.col("disposition") == "accepted")))
    return kept.withColumn("packet_length", F.col("frame_len").cast("long")).select(*PACKET_COLUMNS)


def label_frames(frames: DataFrame, registry: DataFrame) -> DataFrame:
    ordered_frames = monotone_filter(decode_frames(frames), ["capture_id"])
    return disposition(registry_flags(ordered_frames, registry))


def with_endpoints(packets: DataFrame) -> DataFrame:
    """Source and destination view of oriented packets."""
    out = F.col("is_outgoing")
    return packets.withColumns(
        {
            "src_ip": F.when(out, F.col("device_ip")).otherwise(F.col("remote_ip")),
            "dst_ip": F.when(out, F.col("remote_ip")).otherwise(F.col("device_ip")),
            "src_port": F.when(out, F.col("device_port")).otherwise(F.col("remote_port")),
            "dst_port": F.when(out, F.col("remote_port")).otherwise(F.col("device_port")),
        }
    )


def with_locality(packets: DataFrame) -> DataFrame:
    """Multicast, broadcast and global flags.

    Broadcast looks at the addresses only: the engine this follows compares the
    destination MAC in a spelling that never occurs, so MACs have no effect.
    """
    src, dst = F.col("src_ip"), F.col("dst_ip")
    multicast = S.is_multicast(src) | S.is_multicast(dst)
    broadcast = (src == S.LIMITED_BROADCAST) | (dst == S.LIMITED_BROADCAST)
    return packets.withColumns({"is_multicast": multicast, "is_broadcast": broadcast}).withColumn(
        "is_global", ~S.is_private(F.col("remote_ip")) & ~F.col("is_multicast") & ~F.col("is_broadcast")
    )


def with_flow(packets: DataFrame) -> DataFrame:
    """The oriented 5-tuple packed into two LONG columns without loss.

    Fixed-width keys keep distinct counts and first/last aggregates in hash
    aggregation.
    """
    return packets.withColumns(
        {
            "flow_a": F.shiftleft(F.col("proto").cast("long"), 32).bitwiseOR(F.col("device_ip").cast("long")),
            "flow_b": F.shiftleft(F.col("remote_ip").cast("long"), 32)
            .bitwiseOR(F.shiftleft(F.col("device_port").cast("long"), 16))
            .bitwiseOR(F.col("remote_port").cast("long")),
        }
    )


FLOW_KEY = ["proto", "device_ip", "remote_ip", "device_port", "remote_port"]


def flow_ids(packets: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    """Flows of each capture numbered by first appearance."""
    flows = packets.groupBy("capture_id", *FLOW_KEY).agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("packets")
    )
    return ordered.running_sum(flows, ["capture_id"], "first_seq", F.lit(1), "flow_id", bits)


def with_flow_ids(packets: DataFrame, bits: int = ordered.BLOCK_BITS) -> DataFrame:
    ids = flow_ids(packets, bits).drop("first_seq", "packets")
    rows = ordered.with_block(packets, "seq", bits)
    return ordered.attach(rows, ids, ["capture_id", *FLOW_KEY]).drop(ordered.BLOCK)

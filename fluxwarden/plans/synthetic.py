"""Capture bytes built in Spark from the fixture rows, for the capture queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.captures import MAGICS

FRAMES_PER_CAPTURE = 500


def _h(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), size * 2, "0")


def _le(hex_text: Column) -> Column:
    """Reverse the byte order of an eight-digit hexadecimal text."""
    return F.concat(*[F.substring(hex_text, p, 2) for p in (7, 5, 3, 1)])


def frame_hex(df: DataFrame) -> Column:
    """Ethernet + IPv4 + TCP/UDP frame of ``frame_len`` bytes as hexadecimal text."""
    has = set(df.columns)

    def col(name: str, default: int) -> Column:
        return F.coalesce(F.col(name).cast("long"), F.lit(default)) if name in has else F.lit(default)

    ip = F.concat(
        F.lit("4500"), _h(F.col("frame_len") - 14, 2), F.lit("00000000"), _h(col("ip_ttl", 64), 1),
        _h(F.col("proto"), 1), F.lit("0000"), _h(col("src_ip", 0x0A000001), 4), _h(col("dst_ip", 0x0A000002), 4),
    )
    ports = F.concat(_h(col("src_port", 1000), 2), _h(col("dst_port", 2000), 2))
    tcp = F.concat(ports, F.lit("0000000000000000"), F.lit("50"), _h(col("tcp_flags", 0), 1), F.lit("000000000000"))
    udp = F.concat(ports, _h(F.col("frame_len") - 34, 2), F.lit("0000"))
    whole = F.concat(
        F.translate("dst_mac", "-:", ""), F.translate("src_mac", "-:", ""), _h(col("eth_type", 0x0800), 2), ip,
        F.when(F.col("proto") == 6, tcp).otherwise(udp),
    )
    digits = (F.col("frame_len") * 2).cast("int")
    return F.upper(F.rpad(whole, digits, "00"))


def frames_of_packets(packets: DataFrame) -> DataFrame:
    """Packets back to ``(capture_id, seq, ts_us, frame)``."""
    out = F.col("is_outgoing")
    remote = F.lit("02-00-00-00-00-01")
    df = packets.withColumns(
        {
            "src_mac": F.when(out, F.col("device_mac")).otherwise(remote),
            "dst_mac": F.when(out, remote).otherwise(F.col("device_mac")),
            "src_ip": F.when(out, F.col("device_ip")).otherwise(F.col("remote_ip")),
            "dst_ip": F.when(out, F.col("remote_ip")).otherwise(F.col("device_ip")),
            "src_port": F.when(out, F.col("device_port")).otherwise(F.col("remote_port")),
            "dst_port": F.when(out, F.col("remote_port")).otherwise(F.col("device_port")),
            "frame_len": F.col("packet_length"),
        }
    )
    return df.select("capture_id", "seq", "ts_us", F.unhex(frame_hex(df)).alias("frame"))


def capture_files(raw_frames: DataFrame) -> DataFrame:
    """Capture contents of up to 500 consecutive frames each, in turn with every magic."""
    df = raw_frames.withColumn("file_id", F.floor(F.col("seq") / FRAMES_PER_CAPTURE)).repartition("file_id")  # narrow rows, before their bytes
    kinds = list(MAGICS.items())
    kind = F.pmod(F.col("file_id"), F.lit(len(kinds)))

    def by_kind(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (kind + 1).cast("int"))

    little = by_kind([v[0] == "little" for _, v in kinds])
    nano = by_kind([v[1] == "nano" for _, v in kinds])
    extra = F.when(by_kind([v[2] for _, v in kinds]), F.lit("00" * 8)).otherwise("")
    fraction = F.pmod(F.col("ts_us"), F.lit(1_000_000)) * F.when(nano, 1000).otherwise(1)

    def word(value: Column) -> Column:
        text = _h(value, 4)
        return F.when(little, _le(text)).otherwise(text)

    record = F.concat(
        word(F.floor(F.col("ts_us") / 1_000_000)), word(fraction), word(F.col("frame_len")), word(F.col("frame_len")),
        extra, frame_hex(df),
    )
    records = df.select("file_id", "seq", record.alias("record"), by_kind([m for m, _ in kinds]).alias("magic"))
    header_rest = "00" * 20
    return (
        records.groupBy("file_id", "magic")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "record"))), lambda r: r["record"]), "").alias("body"))
        .select(
            F.col("file_id").alias("capture_id"),
            F.unhex(F.concat(F.col("magic"), F.lit(header_rest), F.col("body"))).alias("content"),
        )
    )



"""Column expressions: addresses, ports, flags and the feature scalings.

Everything here is a built-in Catalyst expression; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Offsets of the headers in front of a payload (Ethernet + IPv4 + TCP or UDP).
TCP_HEADER_BYTES = 54
UDP_HEADER_BYTES = 42

# TCP flag bits.
TCP_FLAG_BITS = {
    "tcp_flag_cwr": 0x80,
    "tcp_flag_ece": 0x40,
    "tcp_flag_urg": 0x20,
    "tcp_flag_ack": 0x10,
    "tcp_flag_psh": 0x08,
    "tcp_flag_rst": 0x04,
    "tcp_flag_syn": 0x02,
    "tcp_flag_fin": 0x01,
}

# IPv4 blocks that are not globally routed (IANA special-purpose registry).
PRIVATE_BLOCKS = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
]
# Addresses inside 192.0.0.0/24 that are global all the same.
GLOBAL_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]
# The home network of the detection rules.
HOME_BLOCKS = ["192.168.0.0/16", "10.0.0.0/8", "172.16.0.0/12"]

MULTICAST_BLOCK = "224.0.0.0/4"
LIMITED_BROADCAST = 0xFFFFFFFF


def ip_to_int(text: str) -> int:
    a, b, c, d = (int(part) for part in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def block_range(cidr: str) -> tuple[int, int]:
    base, width = cidr.split("/")
    start = ip_to_int(base)
    return start, start + (1 << (32 - int(width))) - 1


def in_blocks(ip: Column, cidrs: list[str]) -> Column:
    cond = F.lit(False)
    for cidr in cidrs:
        low, high = block_range(cidr)
        cond = cond | ip.between(F.lit(low), F.lit(high))
    return cond


def is_private(ip: Column) -> Column:
    return in_blocks(ip, PRIVATE_BLOCKS) & ~ip.isin([ip_to_int(x) for x in GLOBAL_EXCEPTIONS])


def is_multicast(ip: Column) -> Column:
    return in_blocks(ip, [MULTICAST_BLOCK])


def is_home(ip: Column) -> Column:
    return in_blocks(ip, HOME_BLOCKS)


def mac_key(text: Column) -> Column:
    """Registry form: lower case with dashes."""
    return F.translate(F.lower(text), ":", "-")


def mac_display(text: Column) -> Column:
    """Report form: upper case with colons."""
    return F.translate(F.upper(text), "-", ":")


def mac_from_bytes(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), "(..)(?!$)", "$1-")


def unsigned(raw: Column) -> Column:
    """Big-endian bytes to a LONG."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def ip_text(ip: Column) -> Column:
    octets = [F.shiftright(ip, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def ip_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return sum(
        (parts.getItem(i).cast("long") * F.lit(1 << (24 - 8 * i)) for i in range(1, 4)),
        parts.getItem(0).cast("long") * F.lit(1 << 24),
    )


def log_cap(value: Column, cap: Column | float, floor: float = 0.0) -> Column:
    """log1p of the value clipped to [floor, cap], scaled to [0, 1]."""
    top = (cap if isinstance(cap, Column) else F.lit(float(cap))) - F.lit(float(floor))
    clipped = F.least(F.greatest(value - F.lit(float(floor)), F.lit(0.0)), top)
    return F.log1p(clipped) / F.log1p(top)


def balance(a: Column, b: Column, eps: float = 0.01) -> Column:
    """Symmetric log ratio; 0.5 means both sides are equal."""
    return F.lit(0.5) * (F.lit(1.0) + F.tanh(F.log1p(a + F.lit(eps)) - F.log1p(b + F.lit(eps))))


def safe_div(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def unit_scale(value: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """value / (high - low) clipped to [0, 1]; nulls count as 0."""
    return F.least(
        F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)) / F.lit(high - low), F.lit(0.0)), F.lit(1.0)
    )


def payload_length(length: Column, is_tcp: Column) -> Column:
    return F.when(is_tcp, length - F.lit(TCP_HEADER_BYTES)).otherwise(length - F.lit(UDP_HEADER_BYTES))


def port_classes(port: Column, prefix: str) -> dict[str, Column]:
    return {
        f"{prefix}_port_system": F.when(port <= 1023, 1).otherwise(0),
        f"{prefix}_port_user": F.when(port.between(1024, 49151), 1).otherwise(0),
        f"{prefix}_port_dynamic": F.when(port >= 49152, 1).otherwise(0),
    }


def tcp_flag_columns(flags: Column, is_tcp: Column) -> dict[str, Column]:
    value = F.coalesce(flags.cast("long"), F.lit(0))
    return {
        name: F.when(is_tcp & (value.bitwiseAND(F.lit(bit)) != 0), 1).otherwise(0)
        for name, bit in TCP_FLAG_BITS.items()
    }


def hour_bucket(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(3600))


def day_bucket(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(86400))


def base64_text(raw: Column) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(raw), "\r\n", "")

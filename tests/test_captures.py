"""Hand-made capture files: all formats, faults and header variants."""

import struct

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import packets as P, traffic
from fluxwarden.plans.pipeline import read_packets
from fluxwarden.sources import captures as C

A, B, X = bytes.fromhex("aabbcc000001"), bytes.fromhex("aabbcc000002"), bytes.fromhex("020000000009")


def ipv4(proto, payload, options=b"", fragment=0, src="192.168.0.5", dst="8.8.8.8", length=None):
    ihl = 5 + len(options) // 4
    total = length if length is not None else ihl * 4 + len(payload)
    head = struct.pack(">BBHHHBBH", 0x40 | ihl, 0, total, 0, fragment, 64, proto, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + options + payload


def tcp(sport=1000, dport=443, flags=0x12):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)


def udp(sport=53, dport=5353):
    return struct.pack(">HHHH", sport, dport, 8, 0)


def ether(body, src=A, dst=X, kind=0x0800, vlan=0):
    return dst + src + b"".join(struct.pack(">HH", 0x8100, 7) for _ in range(vlan)) + struct.pack(">H", kind) + body


FRAMES = {
    "tcp": (ether(ipv4(6, tcp())), "accepted"),
    "udp incoming": (ether(ipv4(17, udp()), src=X, dst=B), "accepted"),
    "lan to lan": (ether(ipv4(6, tcp()), src=B, dst=A), "accepted"),
    "options": (ether(ipv4(6, tcp(7, 8), options=b"\x01" * 8)), "accepted"),
    "one tag": (ether(ipv4(6, tcp(9, 10)), vlan=1), "accepted"),
    "two tags": (ether(ipv4(17, udp(11, 12)), vlan=2), "accepted"),
    "no length": (ether(ipv4(6, tcp(13, 14), length=0)), "accepted"),
    "short": (b"\x00" * 13, "too_short"),
    "arp": (ether(b"\x00" * 28, kind=0x0806), "not_ipv4"),
    "ipv6": (ether(b"\x60" + b"\x00" * 39, kind=0x86DD), "not_ipv4"),
    "icmp": (ether(ipv4(1, b"\x08\x00\x00\x00")), "not_tcp_udp"),
    "later fragment": (ether(ipv4(17, b"x" * 32, fragment=5)), "malformed"),
    "cut ip header": (ether(ipv4(6, tcp())[:12]), "malformed"),
    "cut tcp header": (ether(ipv4(6, tcp()[:10])), "malformed"),
    "stranger": (ether(ipv4(6, tcp()), src=X, dst=X), "unknown_device"),
}


def build(magic, frames, step=1000, start=1_700_000_000):
    order, resolution, long_records = C.MAGICS[magic]
    e = ">" if order == "big" else "<"
    out = bytes.fromhex(magic) + struct.pack(e + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for i, frame in enumerate(frames):
        us = 123_456 + i * step
        out += struct.pack(e + "IIII", start, us * (1000 if resolution == "nano" else 1), len(frame), len(frame))
        out += (b"\x00" * 8 if long_records else b"") + frame
    return out


def frame_rows(spark, contents):
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "capture_id long, content binary")
    return C.read_captures(df)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("aa-bb-cc-00-00-01", 0), ("aa-bb-cc-00-00-02", 1)], "device_mac string, position long")


def test_every_format_gives_the_same_frames(spark):
    frames = [f for f, _ in FRAMES.values()]
    rows = frame_rows(spark, [build(m, frames) for m in C.MAGICS]).collect()
    for i in range(len(C.MAGICS)):
        mine = sorted((r for r in rows if r.capture_id == i), key=lambda r: r.seq)
        assert [bytes(r.frame) for r in mine] == frames
        assert [r.ts_us for r in mine] == [1_700_000_000_123_456 + 1000 * k for k in range(len(frames))]


def test_dispositions(spark, registry):
    frames = [f for f, _ in FRAMES.values()]
    labelled = P.label_frames(frame_rows(spark, [build("D4C3B2A1", frames)]), registry).orderBy("seq").collect()
    assert {n: r.disposition for n, r in zip(FRAMES, labelled)} == {n: d for n, (_, d) in FRAMES.items()}
    ports = {n: (r.src_port, r.dst_port, r.tcp_flags) for n, r in zip(FRAMES, labelled)}
    assert ports["tcp"] == (1000, 443, 0x12)
    assert ports["options"][:2] == (7, 8) and ports["one tag"][:2] == (9, 10) and ports["two tags"] == (11, 12, None)
    direction = {r.seq: (r.device_mac, r.is_outgoing) for r in P.assign_device(P.label_frames(frame_rows(spark, [build("D4C3B2A1", frames)]), registry)).collect()}
    assert direction[1] == ("aa-bb-cc-00-00-02", False)
    assert direction[2] == ("aa-bb-cc-00-00-02", True)  # the source wins


def test_out_of_order_frames_do_not_move_the_clock(spark, registry):
    good = FRAMES["tcp"][0]
    times = [10, 20, 15, 20, 19, 30]
    frames = spark.createDataFrame([(0, i, t, bytearray(good)) for i, t in enumerate(times)], "capture_id long, seq long, ts_us long, frame binary")
    kept = [r.seq for r in P.packets_from_frames(frames, registry).orderBy("seq").collect()]
    assert kept == [0, 1, 3, 5]


def test_broken_and_empty_captures(spark, registry):
    whole = build("D4C3B2A1", [FRAMES["tcp"][0], FRAMES["arp"][0]])
    contents = [whole[:-5], whole + b"\x01\x02", build("D4C3B2A1", []), build("D4C3B2A1", [FRAMES["arp"][0]]), bytes.fromhex(C.NEXT_GENERATION) + b"\x00" * 40, b"GIF8"]
    rows = frame_rows(spark, contents).collect()
    cut = sorted((r for r in rows if r.capture_id == 0), key=lambda r: r.seq)
    assert [len(r.frame) for r in cut] == [len(FRAMES["tcp"][0]), len(FRAMES["arp"][0]) - 5]
    assert {r.capture_id: r.read_error for r in rows if r.read_error} == {1: "truncated record header", 4: "unknown file format"}
    captures = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "capture_id long, content binary")
    _, labelled = read_packets(captures, registry)
    totals = {r.capture_id: r for r in traffic.capture_totals(labelled, captures.filter("capture_id in (0, 2, 3)")).collect()}
    assert totals[0].packets == 1 and totals[0].error is None
    assert totals[2].error.endswith("0 packets found in pcap.")
    assert totals[3].error.endswith("1 errors occurred.")


def test_locality_of_special_addresses(spark):
    cases = {"192.0.0.9": True, "192.0.0.8": False, "192.0.0.170": False, "8.8.8.8": True, "172.32.0.1": True, "172.31.255.255": False,
             "224.0.0.251": False, "255.255.255.255": False, "100.64.0.1": True, "198.19.255.255": False}
    from fluxwarden.functions.scalars import ip_to_int

    rows = [(ip, ip_to_int("192.168.0.2"), ip_to_int(ip)) for ip in cases]
    df = spark.createDataFrame(rows, "ip string, src_ip long, dst_ip long").withColumn("remote_ip", F.col("dst_ip"))
    assert {r.ip: r.is_global for r in P.with_locality(df).collect()} == cases


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "one.pcap").write_bytes(build("A1B2C3D4", [FRAMES["tcp"][0]]))
    (tmp_path / "two.pcap").write_bytes(build("34CDB2A1", [FRAMES["tcp"][0]] * 2))
    files = C.scan_files(spark, str(tmp_path))
    assert sorted(r["count"] for r in C.read_captures(files).groupBy("capture_id").count().collect()) == [1, 2]

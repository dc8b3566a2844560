"""Captures cut into byte ranges give the frames of the whole file."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import packets as P
from fluxwarden.sources import captures as C, ranges as R

from test_captures import FRAMES, build


def in_order(df):
    return [(r.ts_us, bytes(r.frame) if r.frame is not None else None, r.read_error) for r in df.orderBy("seq").collect()]


def whole(spark, content):
    return in_order(C.read_captures(spark.createDataFrame([(0, bytearray(content))], "capture_id long, content binary")))


def some_frames(rng, count, inside=b""):
    frames = []
    for _ in range(count):
        body = rng.choice([rng.randbytes(rng.randint(0, 900)), bytes(rng.randint(0, 900)), inside[:rng.randint(0, 900)]])
        frames.append(FRAMES["tcp"][0] + body)
    return frames


def records_of(content, size, max_frame):
    """All ranges of one file, without Spark."""
    import pyarrow as pa

    out = []
    for start in range(0, len(content), size):
        records = R.Records(R.Buffer(pa.BufferReader(content), len(content)), max_frame)
        out += records.frames(start, min(start + size, len(content)))
    return out


@pytest.mark.parametrize("magic", list(C.MAGICS))
def test_every_format_in_ranges(spark, tmp_path, magic):
    content = build(magic, some_frames(random.Random(magic), 300))
    (tmp_path / "one.pcap").write_bytes(content)
    df = R.read_ranges(spark, str(tmp_path), 10_000, 1_000)
    assert df.rdd.getNumPartitions() == -(-len(content) // 10_000) > 5
    assert in_order(df) == whole(spark, content)


def test_captures_inside_captures():
    rng = random.Random(5)
    inner = build("D4C3B2A1", some_frames(rng, 40))
    content = build("D4C3B2A1", some_frames(rng, 2000, inner[24:] * 3))
    expected = records_of(content, len(content), 1 << 18)
    assert len(expected) == 2000
    for size, max_frame in ((1000, 1000), (5000, 20_000), (33_333, 2000)):
        assert records_of(content, size, max_frame) == expected


def test_shifted_headers_are_not_taken_for_records():
    """Four bytes behind each header the fields look like a header as well, but for the time."""
    content = build("A1B2C3D4", [b"\xff" * 60] * 3000)
    records = R.Records(R.Buffer(__import__("pyarrow").BufferReader(content), len(content)), 2_000)
    starts = [24 + 76 * k for k in range(3001)]
    for at in range(100_000, 100_160):
        assert records.start_from(at) == min(s for s in starts if s >= at)


def test_times_that_jump_fall_back_to_the_beginning():
    content = bytearray(build("D4C3B2A1", [FRAMES["tcp"][0]] * 500))
    step = 16 + len(FRAMES["tcp"][0])
    for k in range(100, 500, 50):
        struct.pack_into("<I", content, 24 + k * step, 5)
    assert [r[0] for r in records_of(bytes(content), 3000, 200)] == [24 + k * step for k in range(500)]


def test_damaged_files(spark, tmp_path):
    good = build("D4C3B2A1", [FRAMES["tcp"][0], FRAMES["arp"][0]] * 50)
    long = bytearray(good)
    struct.pack_into("<I", long, 24 + 8, 1 << 30)
    contents = {
        "a": good[:-5], "b": good + b"\x01\x02", "c": build("D4C3B2A1", []), "d": b"GIF8" + bytes(5000), "e": b"", "f": bytes(long), "g": good[:24 + 10],
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = R.read_ranges(spark, str(tmp_path), 1000, 100).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).orderBy("name", "seq").collect()
    errors = [(r.name, r.read_error) for r in rows if r.read_error]
    assert errors == [("b", "truncated record header"), ("d", "unknown file format"), ("e", "unknown file format"), ("f", "implausible record length"), ("g", "truncated record header")]
    sizes = [len(r.frame) for r in rows if r.name == "a"]
    assert len(sizes) == 100 and sizes[-1] == len(FRAMES["arp"][0]) - 5
    assert not [r for r in rows if r.name == "c"]


def test_ranges_to_packets(spark, tmp_path):
    registry = spark.createDataFrame([("aa-bb-cc-00-00-01", 0)], "device_mac string, position long")
    (tmp_path / "one.pcap").write_bytes(build("A1B23C4D", [f for f, _ in FRAMES.values()] * 20))
    frames = R.read_ranges(spark, "file://" + str(tmp_path), 700, 200).filter("read_error is null").select("capture_id", "seq", "ts_us", "frame")
    kept = P.packets_from_frames(frames, registry)
    assert kept.count() == 20 * sum(d == "accepted" and n not in ("udp incoming",) for n, (_, d) in FRAMES.items())
    assert kept.select("capture_id").distinct().count() == 1


def test_small_ranges_share_tasks(spark, tmp_path):
    rng, expected = random.Random(8), {}
    for k in range(40):
        content = build("D4C3B2A1", some_frames(rng, 30)) if k % 10 else b"GIF8" + bytes(3000)
        (tmp_path / f"{k:02}.pcap").write_bytes(content)
        expected[f"{k:02}.pcap"] = content
    df = R.read_ranges(spark, str(tmp_path), 1_000, 1_000)
    ranges = sum(-(-len(c) // 1_000) for c in expected.values())
    assert df.rdd.getNumPartitions() <= 2 * R.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < ranges // 5
    named = df.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).cache()
    for name in ("01.pcap", "11.pcap", "39.pcap"):
        assert in_order(named.filter(F.col("name") == name)) == whole(spark, expected[name])
    assert named.filter("read_error is null").count() == 36 * 30

"""Capture files to raw frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Capture magics as they appear in the file -> byte order, fraction, long record header.
MAGICS = {
    "A1B2C3D4": ("big", "micro", False),
    "D4C3B2A1": ("little", "micro", False),
    "A1B23C4D": ("big", "nano", False),
    "4D3CB2A1": ("little", "nano", False),
    "A1B2CD34": ("big", "micro", True),
    "34CDB2A1": ("little", "micro", True),
}
# Fixed value: the next-generation format is admitted, but not readable here.
NEXT_GENERATION = "0A0D0D0A"

FILE_HEADER = 24
RECORD_HEADER = 16
EXTRA_HEADER = 8
BATCH_FRAMES = 4096
FRAME_SCHEMA = "seq long, ts_us long, frame binary, read_error string"


def admission(captures: DataFrame) -> DataFrame:
    """Accept or reject captures by their first four bytes (``content``)."""
    magic = F.hex(F.substring("content", 1, 4))
    known = F.create_map(*[F.lit(x) for m, v in MAGICS.items() for x in (m, ",".join(map(str, v)))])
    parts = F.split(F.try_element_at(known, magic), ",")
    return captures.withColumns(
        {
            "magic": magic,
            "accepted": magic.isin([*MAGICS, NEXT_GENERATION]),
            "readable": magic.isin(list(MAGICS)),
            "byte_order": parts.getItem(0),
            "resolution": parts.getItem(1),
            "long_records": parts.getItem(2) == "True",
        }
    )


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Capture files as rows; one file is one task, so keep files below 1 GB."""
    return with_capture_id(spark.read.format("binaryFile").load(path))


def stream_files(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """New capture files of a folder as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return with_capture_id(files)


def with_capture_id(files: DataFrame) -> DataFrame:
    """Unique ids that sort by arrival."""
    arrival = F.lpad(F.unix_millis("modificationTime").cast("string"), 14, "0")
    return files.select(F.concat_ws(" ", arrival, "path").alias("capture_id"), "path", "modificationTime", "content")


def split_records(captures: DataFrame) -> DataFrame:
    """Cut capture contents into frames; nothing inside a frame is decoded here.

    A record body that ends early gives a short frame, a record header that ends
    early or an unreadable file gives one row with ``read_error``.
    """
    id_type = captures.schema["capture_id"].dataType.simpleString()
    return captures.select("capture_id", "content").mapInPandas(_split, f"capture_id {id_type}, {FRAME_SCHEMA}")


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for capture_id, content in zip(pdf["capture_id"], pdf["content"]):
            yield from _frames(capture_id, memoryview(content))


def _frames(capture_id, data: memoryview) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []

    def flush() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["capture_id", "seq", "ts_us", "frame", "read_error"]).astype(
            {"seq": "int64", "ts_us": "Int64"}
        )

    known = MAGICS.get(bytes(data[:4]).hex().upper())
    if known is None or len(data) < FILE_HEADER:
        rows.append((capture_id, 0, None, None, "unknown file format"))
        yield flush()
        return
    order, resolution, long_records = known
    head = struct.Struct((">" if order == "big" else "<") + "IIII")
    size = RECORD_HEADER + (EXTRA_HEADER if long_records else 0)
    per_us = 1000 if resolution == "nano" else 1
    at, seq = FILE_HEADER, 0
    while at < len(data):
        if at + size > len(data):
            rows.append((capture_id, seq, None, None, "truncated record header"))
            break
        seconds, fraction, captured, _ = head.unpack_from(data, at)
        at += size
        rows.append((capture_id, seq, seconds * 1_000_000 + fraction // per_us, bytes(data[at : at + captured]), None))
        at += captured
        seq += 1
        if len(rows) == BATCH_FRAMES:
            yield flush()
            rows.clear()
    if rows:
        yield flush()


def read_captures(captures: DataFrame) -> DataFrame:
    """Frames of all admitted captures."""
    return split_records(admission(captures).filter("accepted"))

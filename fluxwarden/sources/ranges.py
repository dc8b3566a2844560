"""Capture files of any size, read in byte ranges: a Python data source for Spark.

A file is cut into ranges of ``rangeBytes``; each range is a partition that yields the records whose headers start in
it. Records have no marks, so a range has to find its first header. It goes back four times the longest frame
(``maxFrameBytes``), takes every offset over the length of one record as a header, and follows the records from it:
lengths, fractions of seconds and times (within ``MAX_DAYS`` of the file's first record) must be plausible all the way
into the range. Where this leads to one place only, that is the range's first header. Where it leads to none or to several
(captures inside captures, zeros, headers with odd values) the range follows the records from the file's beginning,
which is slow and always right. So ranges never disagree about a record, and no value holds more than a record.

A task reads several ranges one after another where there are many small ones: up to ``RANGE_BYTES``, as long as each
core has some tasks.

``seq`` is the byte offset of a record's header: it orders the frames of a capture and does not depend on the ranges.

Files are opened with ``pyarrow.fs``, which reads local paths and the usual remote schemes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .captures import BATCH_FRAMES, EXTRA_HEADER, FILE_HEADER, MAGICS, RECORD_HEADER

RANGE_BYTES = 64 << 20
BUFFER_BYTES = 4 << 20
OPEN_BYTES = 1 << 16  # opening a file takes as long as reading this much
TASKS_PER_CORE = 4
MAX_FRAME_BYTES = 1 << 18  # no capture tool writes more of a frame
MAX_DAYS = 400
#: Frames have about 2^9 bytes, so blocks of 2^25 offsets hold about 2^16 of them (``operators.ordered``).
BLOCK_BITS = 25
SCHEMA = "capture_id string, path string, seq bigint, ts_us bigint, frame binary, read_error string"


@dataclass
class Range:
    path: str
    capture_id: str
    start: int
    end: int
    size: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, those of a file next to each other."""

    ranges: list[Range]


class Buffer:
    """Bytes of a file at any place, read in large pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, count: int) -> bytes:
        """Up to ``count`` bytes, fewer at the end of the file."""
        count = max(0, min(count, self.size - at))
        if at < self.at or at + count > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(max(0, min(max(count, BUFFER_BYTES), self.size - at)), at)
        return self.data[at - self.at:at - self.at + count]


class Records:
    """The record headers of one file."""

    def __init__(self, buffer: Buffer, max_frame: int):
        self.buffer, self.max_frame, self.size = buffer, max_frame, buffer.size
        order, resolution, long_records = MAGICS[buffer.get(0, 4).hex().upper()]
        self.head = struct.Struct((">" if order == "big" else "<") + "IIII")
        self.kind = (">" if order == "big" else "<") + "u4"
        self.length = RECORD_HEADER + (EXTRA_HEADER if long_records else 0)
        self.fractions, self.per_us = (10**9, 1000) if resolution == "nano" else (10**6, 1)
        first = buffer.get(FILE_HEADER, RECORD_HEADER)
        self.seconds = self.head.unpack(first)[0] if len(first) == RECORD_HEADER else 0

    def _plausible(self, seconds, fraction, captured, original):
        near = np.abs(np.asarray(seconds, np.int64) - self.seconds) <= MAX_DAYS * 86_400
        return near & (fraction < self.fractions) & (captured <= self.max_frame) & (original >= captured)

    def start_from(self, at: int) -> int:
        """The first header at or behind a place of the file."""
        if at <= FILE_HEADER:
            return FILE_HEADER
        low = max(FILE_HEADER, at - 4 * (self.max_frame + self.length))
        found = {self._follow(c, at) for c in self._candidates(low, at)} if low > FILE_HEADER else set()
        found.discard(None)
        return found.pop() if len(found) == 1 else self._walk(FILE_HEADER, at)

    def _candidates(self, low: int, at: int) -> list[int]:
        """Places that may hold a header, in a stretch that must hold a true one."""
        data = np.frombuffer(self.buffer.get(low, min(at - low, self.max_frame + self.length) + RECORD_HEADER), np.uint8)
        count = len(data) - RECORD_HEADER + 1
        if count <= 0:
            return []
        words = np.lib.stride_tricks.sliding_window_view(data, 4)
        field = lambda k: np.ascontiguousarray(words[k:k + count]).view(self.kind)[:, 0].astype(np.int64)
        return (low + np.flatnonzero(self._plausible(field(0), field(4), field(8), field(12)))).tolist()

    def _follow(self, at: int, goal: int) -> int | None:
        """Where the records from a place lead at or behind the goal; none if one of them is not plausible."""
        while True:
            header = self.buffer.get(at, RECORD_HEADER)
            if len(header) < RECORD_HEADER:
                return at if at >= goal else None
            fields = self.head.unpack(header)
            if not self._plausible(*fields):
                return None
            if at >= goal:
                return at
            at += self.length + fields[2]

    def _walk(self, at: int, goal: int) -> int:
        while at < goal:
            header = self.buffer.get(at, RECORD_HEADER)
            if len(header) < RECORD_HEADER:
                return self.size
            captured = self.head.unpack(header)[2]
            if captured > self.max_frame:
                return self.size  # reported by the range of this header
            at += self.length + captured
        return at

    def frames(self, start: int, end: int) -> Iterator[tuple]:
        """(seq, ts_us, frame, read_error) of the records that start in a range."""
        at = self.start_from(start)
        while at < min(end, self.size):
            if at + self.length > self.size:
                yield at, None, None, "truncated record header"
                return
            seconds, fraction, captured, _ = self.head.unpack(self.buffer.get(at, RECORD_HEADER))
            if captured > self.max_frame:
                yield at, None, None, "implausible record length"
                return
            yield at, seconds * 1_000_000 + fraction // self.per_us, self.buffer.get(at + self.length, captured), None
            at += self.length + captured


def _filesystem(path: str):
    from pyarrow import fs

    if ":" in path.split("/")[0]:
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.max_frame = int(options.get("maxFrameBytes", MAX_FRAME_BYTES))
        self.tasks = TASKS_PER_CORE * int(options.get("cores", 1 << 30))  # cores unknown: a task for each range

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = system.get_file_info(root)
        files = system.get_file_info(fs.FileSelector(root)) if found.type == fs.FileType.Directory else [found]
        ranges = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith((".", "_")):
                continue
            capture_id = f"{(f.mtime_ns or 0) // 1_000_000:014d} {f.path}"
            for start in range(0, max(f.size, 1), self.range_bytes):
                ranges.append(Range(f.path, capture_id, start, min(start + self.range_bytes, f.size), f.size))
        return self._dealt(ranges)

    def _dealt(self, ranges: list[Range]) -> list[Ranges]:
        cost = [r.end - r.start + (0 if r.start else OPEN_BYTES) for r in ranges]
        goal = max(self.range_bytes, min(RANGE_BYTES, sum(cost) // self.tasks))
        parts, held = [], goal
        for r, c in zip(ranges, cost):
            if held + c > goal:
                parts.append(Ranges([]))
                held = 0
            parts[-1].ranges.append(r)
            held += c
        return parts

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        for path, own in groupby(partition.ranges, key=lambda r: r.path):
            with system.open_input_file(path) as file:
                buffer = None
                for r in own:
                    buffer = buffer or Buffer(file, r.size)
                    yield from self._read(r, buffer)

    def _read(self, partition: Range, buffer: Buffer) -> Iterator[pa.RecordBatch]:
        names = ["capture_id", "path", "seq", "ts_us", "frame", "read_error"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[partition.capture_id] * len(rows), [partition.path] * len(rows), *map(list, zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        if buffer.get(0, 4).hex().upper() not in MAGICS or partition.size < FILE_HEADER:
            if not partition.start:
                yield batch([(0, None, None, "unknown file format")])
            return
        rows, held = [], 0
        for row in Records(buffer, self.max_frame).frames(partition.start, partition.end):
            rows.append(row)
            held += len(row[2] or b"")
            if len(rows) == BATCH_FRAMES or held > BUFFER_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class CaptureRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, max_frame: int = MAX_FRAME_BYTES) -> DataFrame:
    """Frames of the capture files of a folder (or of one file), ``SCHEMA``. A record longer than ``max_frame`` is an
    error of its file."""
    spark.dataSource.register(CaptureRanges)
    options = {"rangeBytes": range_bytes, "maxFrameBytes": max_frame, "cores": spark.sparkContext.defaultParallelism}
    return spark.read.format("capture_ranges").options(**options).load(path)


def write_files(captures: DataFrame, root: str) -> None:
    """Capture contents (name, content) as one file each under ``root``. A repeated task writes the same files."""

    def write(rows) -> None:
        system, folder = _filesystem(root)
        system.create_dir(folder, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(bytes(row["content"]))

    captures.select("name", "content").foreachPartition(write)

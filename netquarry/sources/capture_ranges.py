"""Captures read by byte ranges: a data source that deals one large file over many tasks.

A classic pcap has no marks between its records, so a range that begins anywhere has to find its first record: the
first offset from which a chain of plausible record headers leads on. Such a guess can be wrong, a payload may itself
look like a capture. So every range first tells where its first record begins and where the chain leaves it, two
numbers for each range, and these must meet end to end: a range whose beginning isn't where the one before it ends is
walked again from there, until all meet. What is read is then exactly what one pass over the whole file would read.

Files are opened in the tasks, through the file systems that pyarrow knows. pcapng files take one task each, read block
by block, so their length isn't bounded either.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netquarry.sources.pcap import BATCH, LATEST_SECOND, LONGEST_RECORD, PACKET, PCAPNG_START, capture_format, pcapng_blocks

#: Headers that a guessed first record must lead on to.
CHAIN = 12
#: Bytes that are read at once.
PIECE = 4 << 20
BOUNDS = "capture string, number int, low long, high long, first long, next long"
#: The chain ended in a record too long to be one: nothing after it is read.
STOPPED = -1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def capture_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files at a path, a folder or a pattern of file names, in order; hidden ones left out."""
    head, _, last = path.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    system, inner = opened(head if pattern else path)
    scheme = path[: len(head if pattern else path) - len(inner)] if (head if pattern else path).endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=not pattern))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((scheme + f.path, f.size) for f in files if not pattern or fnmatch.fnmatch(f.base_name, pattern))


@dataclass(frozen=True)
class Range(InputPartition):
    """Records of a capture that start in [low, high); first: where the first of them does, if that is known."""

    capture: str
    number: int
    low: int
    high: int
    first: int | None = None


class Walk:
    """The records that start in [at, high) of an open classic capture; afterwards `at` is where the next one starts, or STOPPED."""

    def __init__(self, handle, size: int, at: int, high: int):
        handle.seek(0)
        order, self.units, self.snap = capture_format(handle.read(24))
        self.handle, self.size, self.at, self.high = handle, size, at, high
        self.header = struct.Struct(f"{order}IIII")
        self.dtype = np.dtype(f"{order}u4")

    def too_long(self, captured: int) -> bool:
        return captured > LONGEST_RECORD or bool(self.snap and captured > 2 * self.snap)

    def records(self) -> Iterator[tuple[int | None, int, int, bytes]]:
        """(microseconds or None for an impossible time, captured, original, data). A record that is cut off raises ValueError."""
        held, base = b"", self.at
        while self.at < self.high:
            ahead = self.at - base
            if ahead + 16 > len(held) or ahead + 16 + self.header.unpack_from(held, ahead)[2] > len(held):
                self.handle.seek(self.at)
                held, base, ahead = self.handle.read(PIECE), self.at, 0
                if len(held) < 16:
                    raise ValueError("the capture ends inside a record header")
            seconds, fraction, captured, original = self.header.unpack_from(held, ahead)
            if self.too_long(captured):
                self.at = STOPPED
                return
            if ahead + 16 + captured > len(held):
                raise ValueError("the capture ends inside a record")
            possible = seconds <= LATEST_SECOND and fraction < self.units
            micros = seconds * 1_000_000 + fraction * 1_000_000 // self.units if possible else None
            self.at += 16 + captured
            yield micros, captured, original, held[ahead + 16 : ahead + 16 + captured]

    def leads_on(self, at: int) -> bool:
        """Whether a chain of CHAIN plausible headers, or one that ends with the file, starts here."""
        for _ in range(CHAIN):
            if at == self.size:
                return True
            self.handle.seek(at)
            head = self.handle.read(16)
            if len(head) < 16:
                return False
            seconds, fraction, captured, _ = self.header.unpack(head)
            if seconds > LATEST_SECOND or fraction >= self.units or self.too_long(captured) or at + 16 + captured > self.size:
                return False
            at += 16 + captured
        return True

    def first_from(self, low: int, high: int) -> int:
        """The first offset in [low, high) that looks like a record's; high if none does."""
        while low < high:
            self.handle.seek(low)
            data = self.handle.read(min(PIECE, high - low) + 15)
            n = min(high - low, len(data) - 15)
            if n <= 0:
                return high
            seconds, fraction, captured = (self._words(data, n, 4 * k) for k in range(3))
            # of runs of zeros no byte begins a record
            likely = (seconds > 0) & (seconds <= LATEST_SECOND) & (fraction < self.units) & (captured > 0) & (captured <= LONGEST_RECORD)
            if self.snap:
                likely &= captured <= 2 * self.snap
            for at in np.flatnonzero(likely).tolist():
                if self.leads_on(low + at):
                    return low + at
            low += n
        return high

    def _words(self, data: bytes, n: int, skip: int) -> np.ndarray:
        """The four-byte numbers at the n offsets from skip on."""
        out = np.empty(n, np.int64)
        for k in range(min(4, n)):
            count = (n - k + 3) // 4
            out[k::4] = np.frombuffer(data, self.dtype, count, skip + k)
        return out


def bounds(part: Range) -> tuple[int, int]:
    """(where the first record of the range starts, where the record after its last does); both high if none starts in it."""
    system, path = opened(part.capture)
    with system.open_input_file(path) as handle:
        size = handle.size()
        walk = Walk(handle, size, 0, part.high)
        first = part.first if part.first is not None else 24 if part.low == 0 else walk.first_from(part.low, part.high)
        if part.first is None and first >= part.high and part.low:
            return part.high, part.high
        walk.at = first
        try:
            for _ in walk.records():
                pass
        except ValueError:  # a record that is cut off, or no record at all: told when it is read, if it is
            return first, size
        return first, walk.at


def packets_of_range(part: Range) -> Iterator[tuple[int, int, int, bytes]]:
    """The packets of a range; a file that isn't a classic pcap is one range."""
    system, path = opened(part.capture)
    with system.open_input_file(path) as handle:
        if handle.read(4) == PCAPNG_START:
            handle.seek(0)
            yield from pcapng_blocks(handle.read)
            return
        size = handle.size()
        walk = Walk(handle, size, part.first if part.first is not None else 24, part.high)
        for micros, captured, original, data in walk.records():
            if micros is not None:
                yield micros, captured, original, data


class CaptureSource(DataSource):
    """Format "capture". Options: path; ranges, their bounds as read_capture makes them; bounds "true" for a table of these.

    range_bytes, the length of a range, plays a part only without ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return BOUNDS if self.options.get("bounds") == "true" else f"{PACKET}, capture string"

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(dict(self.options))


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only_bounds = options["path"], options.get("bounds") == "true"
        self.length, self.known = int(options.get("range_bytes", 128 << 20)), json.loads(options.get("ranges", "null"))

    def partitions(self) -> list[Range]:
        if self.known is not None:
            return [Range(*r) for r in self.known] or [Range("", -1, 0, 0)]
        out = []
        for path, size in capture_files(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as handle:
                whole = handle.read(4) == PCAPNG_START
            step = max(1, size if whole else self.length)
            out += [Range(path, k, low, min(low + step, size)) for k, low in enumerate(range(0, max(size, 1), step))]
        return out or [Range("", -1, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.number < 0:
            return
        if self.only_bounds:
            system, inner = opened(part.capture)
            with system.open_input_file(inner) as handle:
                whole = handle.read(4) == PCAPNG_START
            first, after = (0, part.high) if whole else bounds(part)
            values = [[part.capture], [part.number], [part.low], [part.high], [first], [after]]
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in BOUNDS.split(", ")])
            return
        held: list = []
        for packet in packets_of_range(part):
            held.append(packet)
            if len(held) == BATCH:
                yield _batch(held, part.capture)
                held = []
        if held:
            yield _batch(held, part.capture)


def _batch(packets: list, capture: str) -> pa.RecordBatch:
    micros, captured, original, data = zip(*packets, strict=True)
    columns = [
        pa.array(micros, pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(captured, pa.int32()),
        pa.array(original, pa.int64()).cast(pa.int32(), safe=False), pa.array(data, pa.binary()), pa.array([capture] * len(packets), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["timestamp", "captured_length", "original_length", "data", "capture"])


def capture_ranges(spark: SparkSession, path: str, range_bytes: int = 128 << 20) -> list[Range]:
    """The ranges of the captures at a path, each with its first record, so that they meet end to end (see above).

    Ranges without a record, and what lies behind a record too long to be one, are left out.
    """
    spark.dataSource.register(CaptureSource)
    ask = spark.read.format("capture").option("bounds", "true").option("range_bytes", str(range_bytes))
    rows = sorted(ask.load(path).collect(), key=lambda r: (r["capture"], r["number"]))  # a row for each range
    known = {(r["capture"], r["number"]): (r["first"], r["next"]) for r in rows}
    while True:
        out, again = [], []
        before = None
        for r in rows:
            key = (r["capture"], r["number"])
            at = known[key][0] if r["number"] == 0 else before
            if at == STOPPED or at >= r["high"]:
                before = at
                continue
            if known[key][0] != at:
                again.append(Range(r["capture"], r["number"], r["low"], r["high"], at))
            out.append(Range(r["capture"], r["number"], r["low"], r["high"], at))
            before = known[key][1]
        if not again:
            return out
        asked = json.dumps([[r.capture, r.number, r.low, r.high, r.first] for r in again])
        for r in spark.read.format("capture").option("bounds", "true").option("ranges", asked).load(path).collect():
            known[r["capture"], r["number"]] = (r["first"], r["next"])


def read_capture(spark: SparkSession, path: str, range_bytes: int = 128 << 20) -> DataFrame:
    """Packets (timestamp, captured_length, original_length, data, capture) of the captures at a path, a task for each range.

    An oversized record ends its file, an impossible time is skipped, a record that is cut off raises when it is read.
    """
    ranges = capture_ranges(spark, path, range_bytes)
    asked = json.dumps([[r.capture, r.number, r.low, r.high, r.first] for r in ranges])
    return spark.read.format("capture").option("ranges", asked).load(path)

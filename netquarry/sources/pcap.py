"""Packet captures as DataFrames: classic pcap in four byte orders and resolutions, and pcapng.

Files are read by byte ranges (see capture_ranges), so one large file is dealt over many tasks. A store that only Spark
can open is read through its binaryFile source instead: there a file is one row of bytes and so at most 2 GB, split
longer ones at record boundaries first (split_capture_file, in constant memory). Frames are parsed with column
expressions only.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET = "timestamp timestamp, captured_length int, original_length int, data binary"
#: Fixed values of the formats.
MAGICS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
PCAPNG, PCAPNG_START = 0x0A0D0D0A, b"\x0a\x0d\x0d\x0a"
BYTE_ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
LONGEST_RECORD, LATEST_SECOND, LONGEST_PIECE_RECORD = 262_144, 4_102_444_800, 16 << 20
BATCH = 20_000


def capture_format(data: bytes) -> tuple[str, int, int]:
    """(byte order, units per second, snapshot length) of a classic pcap."""
    if len(data) < 24:
        raise ValueError("the capture has no complete global header")
    for order in "<>":
        magic = struct.unpack(f"{order}I", data[:4])[0]
        if magic in MAGICS:
            return order, MAGICS[magic], struct.unpack(f"{order}I", data[16:20])[0]
    raise ValueError(f"no pcap magic: {data[:4].hex()}")


def classic_packets(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(microseconds, captured, original, bytes). An oversized record ends the file, an impossible time is skipped.

    A record that is cut off raises ValueError. Nanoseconds are cut to microseconds.
    """
    order, units, snap = capture_format(data)
    record, at = struct.Struct(f"{order}IIII"), 24
    while at < len(data):
        if at + 16 > len(data):
            raise ValueError("the capture ends inside a record header")
        seconds, fraction, captured, original = record.unpack_from(data, at)
        if captured > LONGEST_RECORD or (snap and captured > 2 * snap):
            return
        at += 16
        if at + captured > len(data):
            raise ValueError("the capture ends inside a record")
        if seconds <= LATEST_SECOND and fraction < units:
            yield seconds * 1_000_000 + fraction * 1_000_000 // units, captured, original, data[at : at + captured]
        at += captured


def pcapng_packets(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """pcapng_blocks of a capture in memory."""
    return pcapng_blocks(io.BytesIO(data).read)


def pcapng_blocks(read: Callable[[int], bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """Packets of enhanced, obsolete and simple packet blocks; the last have no time and get 0. Reads a block at a time.

    A block that is cut off, its header included, and an unknown byte-order magic raise ValueError.
    """
    order, units = "<", []
    while head := read(12):
        if len(head) < 12:
            raise ValueError("the capture ends inside a block header")
        kind = struct.unpack_from(f"{order}I", head)[0]
        if kind == PCAPNG:
            if (magic := head[8:12]) not in BYTE_ORDERS:
                raise ValueError(f"no pcapng byte-order magic: {magic.hex()}")
            order = BYTE_ORDERS[magic]
            units = []
        length = struct.unpack_from(f"{order}I", head, 4)[0]
        rest = read(length - 12) if length >= 12 else b""
        if length < 12 or len(rest) < length - 12:
            raise ValueError("the capture ends inside a block")
        body = (head[8:] + rest)[:-4]
        if kind == 1:
            units.append(_resolution(body, order))
        elif kind in (2, 6):
            if kind == 6:
                interface, high, low, captured, original = struct.unpack_from(f"{order}IIIII", body)
            else:
                interface, _, high, low, captured, original = struct.unpack_from(f"{order}HHIIII", body)
            per_second = units[interface] if interface < len(units) else 1_000_000
            yield (high << 32 | low) * 1_000_000 // per_second, captured, original, body[20 : 20 + captured]
        elif kind == 3:
            original = struct.unpack_from(f"{order}I", body)[0]
            packet = body[4 : 4 + original]
            yield 0, len(packet), original, packet


def _resolution(body: bytes, order: str) -> int:
    """Units per second that an interface block names in option 9, a power of 10 or of 2; else microseconds."""
    at = 8
    while at + 4 <= len(body):
        code, length = struct.unpack_from(f"{order}HH", body, at)
        if code == 0:
            break
        if code == 9 and length >= 1:
            value = body[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        at += 4 + (length + 3) // 4 * 4
    return 1_000_000


def packets_of(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    return pcapng_packets(data) if data[:4] == PCAPNG_START else classic_packets(data)


def classic_bytes(packets: Iterator[tuple[int, int, int, bytes]], snap: int = LONGEST_RECORD) -> bytes:
    """A little-endian microsecond pcap of the packets; with pcapng_packets it converts."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snap, 1)]
    for micros, captured, original, data in packets:
        out.append(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, captured, original) + data)
    return b"".join(out)


def pcapng_bytes(packets: Iterator[tuple[int, int, int, bytes]], snap: int = LONGEST_RECORD) -> bytes:
    """A little-endian pcapng section of the packets, in microseconds."""
    out = [struct.pack("<IIIHHqI", PCAPNG, 28, 0x1A2B3C4D, 1, 0, -1, 28), struct.pack("<IIHHII", 1, 20, 1, 0, snap, 20)]
    for micros, captured, original, data in packets:
        padded = data + b"\x00" * (-len(data) % 4)
        length = 32 + len(padded)
        out.append(struct.pack("<IIIIIII", 6, length, 0, micros >> 32, micros & 0xFFFFFFFF, captured, original) + padded + struct.pack("<I", length))
    return b"".join(out)


def capture_pieces(capture: BinaryIO, most: int) -> Iterator[bytes]:
    """A classic pcap in pieces of at most `most` bytes (or one record), each with the header; a corrupt record ends it.

    Reads on as it yields, so a capture of any length takes the memory of one piece.
    """
    header = capture.read(24)
    order, _, _ = capture_format(header)
    held, size, pieces = [header], len(header), 0
    while len(head := capture.read(16)) == 16:
        captured = struct.unpack_from(f"{order}I", head, 8)[0]
        data = capture.read(captured) if captured <= LONGEST_PIECE_RECORD else b""
        if captured > LONGEST_PIECE_RECORD or len(data) < captured:
            break
        if len(held) > 1 and size + 16 + captured > most:
            yield b"".join(held)
            held, size, pieces = [header], len(header), pieces + 1
        held += [head, data]
        size += 16 + captured
    if len(held) > 1 or not pieces:
        yield b"".join(held)


def split_capture(data: bytes, most: int) -> list[bytes]:
    """capture_pieces of a capture in memory."""
    return list(capture_pieces(io.BytesIO(data), most))


def split_capture_file(path: str, folder: str, most: int) -> list[str]:
    """Write a local capture's pieces to a folder that Spark can read, as name-0000.pcap ..., and return their paths."""
    name, out = os.path.splitext(os.path.basename(path))[0], []
    with open(path, "rb") as capture:
        for k, piece in enumerate(capture_pieces(capture, most)):
            out.append(os.path.join(folder, f"{name}-{k:04}.pcap"))
            with open(out[-1], "wb") as handle:
                handle.write(piece)
    return out


def _files_to_packets(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in files:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            held, before = [], 0
            for packet in packets_of(bytes(content)):
                held.append(packet)
                if len(held) == BATCH:
                    yield _frame(held, path, before)
                    held, before = [], before + BATCH
            if held:
                yield _frame(held, path, before)


def _frame(packets: list[tuple[int, int, int, bytes]], path: str, before: int) -> pd.DataFrame:
    out = pd.DataFrame(packets, columns=["timestamp", "captured_length", "original_length", "data"])
    out["timestamp"] = pd.to_datetime(out["timestamp"], unit="us", utc=True)
    return out.assign(capture=path, place=range(before, before + len(out)))


def packets_in(files: DataFrame, place: str | None = None) -> DataFrame:
    """Packets (timestamp, captured_length, original_length, data, capture) of files (path, content); a task per file.

    place: name of a further column, the packet's place in its file from 0.
    """
    found = files.select("path", "content").mapInPandas(_files_to_packets, f"{PACKET}, capture string, place long")
    return found.withColumnRenamed("place", place) if place else found.drop("place")


def read_pcap(spark: SparkSession, path: str, range_bytes: int = 128 << 20) -> DataFrame:
    """The packets of all files at path, by ranges of range_bytes; the packets_in them where only Spark opens the store."""
    from netquarry.sources.capture_ranges import opened, read_capture

    try:
        opened(path)
    except (pa.ArrowInvalid, ValueError):  # not a file system of pyarrow
        return packets_in(spark.read.format("binaryFile").load(path))
    return read_capture(spark, path, range_bytes)


def _number(data: Column, at: Column | int, length: int) -> Column:
    """The big-endian number of `length` bytes from the offset `at`."""
    part = F.substr(data, F.lit(at).cast("int") + 1 if isinstance(at, int) else at.cast("int") + 1, F.lit(length))
    return F.conv(F.hex(part), 16, 10).cast("bigint")


def parse_packets(packets: DataFrame, light: bool = False) -> DataFrame:
    """packets with the fields of Ethernet, IPv4 or IPv6, TCP or UDP headers in the place of data; null where absent.

    No VLAN tags and no IPv6 extension headers. light: addresses, ports and protocol only. IPv6 is written as eight
    full groups in lower case. The payload is the length the IP header names without the headers.
    """
    data, n = F.col("data"), F.octet_length("data")
    kind = F.when(n >= 14, _number(data, 12, 2))
    ihl = _number(data, 14, 1).bitwiseAND(F.lit(15)) * 4
    v4 = F.coalesce((kind == 0x0800) & (n >= 34) & (ihl >= 20) & (n >= 14 + ihl), F.lit(False))
    v6 = F.coalesce((kind == 0x86DD) & (n >= 54), F.lit(False))
    out = packets.withColumns({"_v4": v4, "_v6": v6})
    v4, v6 = F.col("_v4"), F.col("_v6")
    out = out.withColumns(
        {
            "_l4": F.when(v4, 14 + ihl).when(v6, F.lit(54)),
            "_protocol": F.when(v4, _number(data, 23, 1)).when(v6, _number(data, 20, 1)),
            "_ip_payload": F.when(v4, _number(data, 16, 2) - ihl).when(v6, _number(data, 18, 2)),
        }
    )
    l4 = F.col("_l4")
    tcp, udp = F.col("_protocol") == 6, F.col("_protocol") == 17
    out = out.withColumns({"_tcp": F.coalesce(tcp & (n >= l4 + 20), F.lit(False)), "_udp": F.coalesce(udp & (n >= l4 + 8), F.lit(False))})
    tcp_here, udp_here = F.col("_tcp"), F.col("_udp")
    dotted = lambda at: F.concat_ws(".", *[_number(data, at + i, 1).cast("string") for i in range(4)])
    groups = lambda at: F.concat_ws(":", *[F.lower(F.hex(F.substr(data, F.lit(at + 1 + 2 * i), F.lit(2)))) for i in range(8)])
    header = F.shiftright(_number(data, l4 + 12, 1), 4) * 4
    whole = tcp_here & (n >= l4 + header)
    fields = {
        "src_ip": F.when(v4, dotted(26)).when(v6, groups(22)),
        "dst_ip": F.when(v4, dotted(30)).when(v6, groups(38)),
        "src_port": F.when(tcp_here | udp_here, _number(data, l4, 2)).cast("int"),
        "dst_port": F.when(tcp_here | udp_here, _number(data, l4 + 2, 2)).cast("int"),
        "protocol": F.when(tcp, "TCP").when(udp, "UDP"),
    }
    if not light:
        fragment = _number(data, 20, 2)
        fields |= {
            "ip_version": F.when(v4, 4).when(v6, 6),
            "ttl": F.when(v4, _number(data, 22, 1)).when(v6, _number(data, 21, 1)).cast("int"),
            "is_fragmented": F.when(v4, fragment.bitwiseAND(F.lit(0x3FFF)) > 0),
            "fragment_offset": F.when(v4, fragment.bitwiseAND(F.lit(0x1FFF))).cast("int"),
            "payload_length": F.when(whole, F.col("_ip_payload") - header).when(udp_here, F.col("_ip_payload") - 8).cast("int"),
            "tcp_window": F.when(whole, _number(data, l4 + 14, 2)).cast("int"),
            "tcp_seq": F.when(whole, _number(data, l4 + 4, 4)),
            "tcp_ack": F.when(whole, _number(data, l4 + 8, 4)),
            "tcp_flags": F.when(whole, _number(data, l4 + 13, 1)).cast("int"),
        }
    rest = [c for c in packets.columns if c not in ("data", "timestamp", "captured_length", "original_length")]
    return out.select("timestamp", *[v.alias(k) for k, v in fields.items()], *rest)

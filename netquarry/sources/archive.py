"""Zip archives, nested ones too, as inventories of captures; members extracted by byte ranges, checked and resumed.

An archive is a file that can seek: its directory is read from its end (zip64 too) and a member from its offset, never
the whole. A stored archive within an archive is a range of the outer file; a deflated one is inflated as it is read.
"""

from __future__ import annotations

import contextlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scalars import is_capture
from netquarry.sources.capture_ranges import capture_files, opened

INVENTORY = "archive string, entry string, compressed_size long, uncompressed_size long, method int, crc long"
EXTRACTED = "archive string, entry string, path string, size long"
PIECE = 1 << 20


class FileRange(io.RawIOBase):
    """The bytes [low, low + length) of a file that can seek, as a file of their own."""

    def __init__(self, file: BinaryIO, low: int, length: int):
        self.file, self.low, self.length, self.at = file, low, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.length)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.length - self.at))
        self.file.seek(self.low + self.at)
        data = self.file.read(n)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def member_range(file: BinaryIO, info: zipfile.ZipInfo) -> FileRange:
    """A member's bytes as they lie in the archive: its header names the lengths of its own name and extra field."""
    file.seek(info.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member where the directory names {info.filename}")
    name, extra = struct.unpack_from("<HH", head, 26)
    return FileRange(file, info.header_offset + 30 + name + extra, info.compress_size)


def inner_archive(file: BinaryIO, archive: zipfile.ZipFile, info: zipfile.ZipInfo, stack: contextlib.ExitStack) -> BinaryIO:
    """An archive within an archive as a file that can seek."""
    if info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1:
        return member_range(file, info)
    return stack.enter_context(archive.open(info))


def zip_entries(file: BinaryIO, chain: str = "") -> Iterator[tuple[str, int, int, int, int]]:
    """(entry, compressed, uncompressed, method, CRC) of a zip and of zips in it; a nested entry is named outer!inner."""
    with contextlib.ExitStack() as stack:
        archive = stack.enter_context(zipfile.ZipFile(file))
        for info in archive.infolist():
            yield chain + info.filename, info.compress_size, info.file_size, info.compress_type, info.CRC
            if info.filename.lower().endswith(".zip"):
                yield from zip_entries(inner_archive(file, archive, info, stack), f"{chain}{info.filename}!")


def _frame(path: str, file: BinaryIO) -> pd.DataFrame:
    return pd.DataFrame([(path, *entry) for entry in zip_entries(file)], columns=[c.split()[0] for c in INVENTORY.split(", ")])


def _list_contents(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in files:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            yield _frame(path, io.BytesIO(content))


def _list_files(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in files:
        for path in frame["path"]:
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                yield _frame(path, file)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """All entries of all archives at path, a task for each archive, which reads no more than directories.

    A store that only Spark opens is read whole, a file a row.
    """
    try:
        found = [p for p, _ in capture_files(path)]
    except (pa.ArrowInvalid, ValueError):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_list_contents, INVENTORY)
    paths = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, len(found)))
    return paths.mapInPandas(_list_files, INVENTORY)


def captures(entries: DataFrame) -> DataFrame:
    """The entries that are captures."""
    return entries.filter(is_capture(F.col("entry")))


def write_inventory(entries: DataFrame, path: str) -> None:
    """CSV by day; entries needs a day column."""
    entries.write.mode("overwrite").partitionBy("day").option("header", True).csv(path)


def day_rows(spark: SparkSession, path: str, day: str) -> DataFrame:
    """A day's rows of a written inventory; only its folder is read."""
    return spark.read.option("header", True).csv(path).filter(F.col("day").cast("string") == day)


def extract_entry(source: bytes | str | BinaryIO, entry: str, target: str) -> int:
    """Write one entry (outer!inner for nested zips) to a file, checked by size and CRC, whole or not at all; its size.

    source: an archive's bytes, its path or an open file; target: a path of a file system that pyarrow knows. Data is
    copied in pieces, so neither archive nor entry need fit in memory. An extraction that was broken off leaves a .part
    file, which the next one goes on with, where files can be appended to: a stored member is read from there on, a
    deflated one inflated to there without being written again. The checksum is that of the whole; if it differs the
    .part file goes, and ValueError is raised.
    """
    system, place = opened(target)
    part = f"{place}.part"
    system.create_dir(place.rpartition("/")[0] or "/", recursive=True)
    with contextlib.ExitStack() as stack:
        file = _as_file(source, stack)
        archive = stack.enter_context(zipfile.ZipFile(file))
        *outer, name = entry.split("!")
        for step in outer:
            file = inner_archive(file, archive, archive.getinfo(step), stack)
            archive = stack.enter_context(zipfile.ZipFile(file))
        info = archive.getinfo(name)
        size, check = _already(system, part, info.file_size)
        content = stack.enter_context(archive.open(info))
        handle = stack.enter_context(system.open_append_stream(part) if size else system.open_output_stream(part))
        if size and info.compress_type == zipfile.ZIP_STORED:
            content = member_range(file, info)
            content.seek(size)
        else:
            left = size
            while left:
                left -= len(content.read(min(left, PIECE)))
        while piece := content.read(PIECE):
            handle.write(piece)
            size, check = size + len(piece), zlib.crc32(piece, check)
    if size != info.file_size or check != info.CRC:
        system.delete_file(part)
        raise ValueError(f"size or checksum of {entry} differs")
    system.move(part, place)
    return size


def _as_file(source: bytes | str | BinaryIO, stack: contextlib.ExitStack) -> BinaryIO:
    if isinstance(source, bytes):
        return io.BytesIO(source)
    if isinstance(source, str):
        system, inner = opened(source)
        return stack.enter_context(system.open_input_file(inner))
    return source


def _already(system: fs.FileSystem, part: str, most: int) -> tuple[int, int]:
    """Size and CRC of what a broken extraction has left; nothing where files can't be appended to."""
    info = system.get_file_info(part)
    if info.type != fs.FileType.File or not 0 < info.size <= most or not isinstance(system, fs.LocalFileSystem | fs.HadoopFileSystem):
        return 0, 0
    size = check = 0
    with system.open_input_stream(part) as held:
        while piece := held.read(PIECE):
            size, check = size + len(piece), zlib.crc32(piece, check)
    return size, check


def extract(entries: DataFrame, folder: str) -> DataFrame:
    """(archive, entry, path, size) of entries of an inventory that have a column name, written to folder under it; a task each.

    A file that is there with the entry's size is left as it is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                path = f"{folder}/{row.name}"
                system, inner = opened(path)
                size = system.get_file_info(inner).size
                if size != row.uncompressed_size:
                    size = extract_entry(row.archive, row.entry, path)
                yield pd.DataFrame([(row.archive, row.entry, path, size)], columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    slim = entries.select("archive", "entry", "name", "uncompressed_size")
    return slim.repartitionByRange(max(1, slim.count()), "archive", "entry").mapInPandas(run, EXTRACTED)

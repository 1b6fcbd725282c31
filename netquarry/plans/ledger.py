"""Batches that survive a kill: a ledger written ahead of each step, and drivers for a day and for an archive over it.

A batch is planned, extracted and committed, in that order, and the batches one after the other. The ledger is a JSON file
that is replaced by an atomic rename, so it is whole at any time, and it says what is done, never what is only begun. A
step that was broken off is done again: extraction goes on with what lies there in full, and the rows of a batch are a
partition of the target that replaces itself. So a job that is killed anywhere and run again leaves the same table.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scalars import capture_name
from netquarry.operators.packing import plan_batches
from netquarry.sources import archive
from netquarry.sources.capture_ranges import opened

#: Bytes that stay free on the captures' disk.
RESERVE = 10 << 30
PLANNED, EXTRACTED, COMMITTED = "planned", "extracted", "committed"


class Ledger:
    """The batches of a job: [{"entries": [[name, size], ...], "state": ..., "rows": ...}, ...] in folder/ledger.json."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.system, self.inner = opened(self.folder)
        self.system.create_dir(self.inner, recursive=True)
        self.batches: list[dict] | None = None
        if self.system.get_file_info(f"{self.inner}/ledger.json").type == fs.FileType.File:
            with self.system.open_input_stream(f"{self.inner}/ledger.json") as handle:
                self.batches = json.loads(handle.read())

    def write(self) -> None:
        with self.system.open_output_stream(f"{self.inner}/ledger.json.part") as handle:
            handle.write(json.dumps(self.batches).encode())
        self.system.move(f"{self.inner}/ledger.json.part", f"{self.inner}/ledger.json")

    def plan(self, entries: Sequence[tuple[str, int]], batch_bytes: int) -> None:
        """Batches of consecutive entries (name, bytes), each of batch_bytes at most or of one entry. A plan that is there stays."""
        if self.batches is not None:
            return
        self.batches = []
        for (name, size), number in zip(entries, plan_batches([size for _, size in entries], batch_bytes), strict=True):
            if number == len(self.batches):
                self.batches.append({"entries": [], "state": PLANNED, "rows": None})
            self.batches[number]["entries"].append([name, size])
        self.write()

    def mark(self, number: int, state: str, rows: int | None = None) -> None:
        self.batches[number] |= {"state": state, "rows": rows}
        self.write()

    def checked(self) -> None:
        """Raise ValueError if a batch is committed though one before it isn't."""
        states = [b["state"] == COMMITTED for b in self.batches]
        if states != sorted(states, reverse=True):
            raise ValueError(f"batch {states.index(False)} isn't committed, but a later one is")


def free_space_for(folder: str, size: int, reserve: int = RESERVE) -> None:
    """Raise OSError if a local folder's disk would keep less than reserve bytes with size more of them."""
    system, inner = opened(folder)
    if isinstance(system, fs.LocalFileSystem) and (free := shutil.disk_usage(inner).free) < size + reserve:
        raise OSError(f"{folder} has {free} bytes free, {size} and a reserve of {reserve} are needed")


def _there(folder: str, name: str, size: int) -> bool:
    system, inner = opened(f"{folder}/{name}")
    info = system.get_file_info(inner)
    return info.type == fs.FileType.File and info.size == size


def day_job(
    spark: SparkSession,
    entries: DataFrame,
    folder: str,
    target: str,
    process: Callable[[str], DataFrame],
    *,
    batch_bytes: int = 8 << 30,
    reserve: int = RESERVE,
    step: Callable[[str], None] = lambda what: None,
) -> int:
    """The captures of one day, batch by batch, to a table partitioned by batch: the number of its rows.

    entries: an inventory's captures with a column name, each name once. folder: for the ledger and, while a batch is
    worked on, its captures. process: a folder of captures to rows. A batch is skipped if it is committed; if its rows are
    not where they were written, or a later batch is committed before an earlier one, ValueError is raised. step is told
    what has just been done.
    """
    ledger, captures = Ledger(folder), f"{folder.rstrip('/')}/captures"
    order = entries.select("name", "uncompressed_size").orderBy("name").collect()  # a row for each capture of the day
    if len({r["name"] for r in order}) < len(order):
        raise ValueError("two captures of the day have the same name")
    ledger.plan([(r["name"], r["uncompressed_size"]) for r in order], batch_bytes)
    ledger.checked()
    step("planned")
    system, inner = opened(target)
    for number, batch in enumerate(ledger.batches):
        place = f"{inner}/batch={number}"
        if batch["state"] == COMMITTED:
            if batch["rows"] and system.get_file_info(place).type != fs.FileType.Directory:
                raise ValueError(f"batch {number} is committed, but its rows are gone")
            _removed(f"{captures}/{number}")
            continue
        lacking = [name for name, size in batch["entries"] if not _there(f"{captures}/{number}", name, size)]
        if lacking:
            opened(captures)[0].create_dir(opened(f"{captures}/{number}")[1], recursive=True)
            free_space_for(f"{captures}/{number}", sum(size for name, size in batch["entries"] if name in lacking), reserve)
            archive.extract(entries.filter(F.col("name").isin(lacking)), f"{captures}/{number}").count()
            step("captures")
        if batch["state"] == PLANNED:
            ledger.mark(number, EXTRACTED)
            step("extracted")
        rows = process(f"{captures}/{number}").withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        step("rows")
        n = 0
        if system.get_file_info(place).type == fs.FileType.Directory:
            n = spark.read.parquet(f"{target.rstrip('/')}/batch={number}").count()
        ledger.mark(number, COMMITTED, n)
        step("committed")
        _removed(f"{captures}/{number}")
    return sum(b["rows"] for b in ledger.batches)


def _removed(folder: str) -> None:
    system, inner = opened(folder)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


def archive_job(spark: SparkSession, path: str, folder: str, target: str, process: Callable[[str], DataFrame], **options: object) -> dict[str, int]:
    """day_job for each archive at path, each a day named after its file: the rows of each. Captures get capture_name.

    The target has a folder for each day; options: those of day_job.
    """
    found = archive.captures(archive.inventory(spark, path))
    day = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.[^.]*$", "")
    found = found.withColumn("day", day).withColumn("name", capture_name(F.col("day"), F.element_at(F.split("entry", "!"), -1)))
    days = sorted(r["day"] for r in found.select("day").distinct().collect())  # a row for each archive
    return {d: day_job(spark, found.filter(F.col("day") == d), f"{folder.rstrip('/')}/{d}", f"{target.rstrip('/')}/day={d}", process, **options) for d in days}

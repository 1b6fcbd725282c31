"""Scalar functions over columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted timestamp formats, tried in turn: with and without a fraction.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")


def timestamp_sql(text: str, formats: Sequence[str] = TIMESTAMP_FORMATS) -> str:
    """SQL for the timestamp of an SQL text under the first format that fits, else null.

    A format of numbers fits texts with a point only if it has one itself: the others aren't tried, as each failure
    costs an exception.
    """
    tries = []
    for f in formats:
        numbers = re.fullmatch(r"[yMdHhmsS :/.-]*", f) and "MMM" not in f
        fitting = f"if(instr({text}, '.') {'>' if '.' in f else '='} 0, {text}, NULL)" if numbers else text
        tries.append(f"try_to_timestamp({fitting}, '{f}')")
    return f"coalesce({', '.join(tries)})"


def parsed_timestamp(column: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """The timestamp under the first format that fits, else null."""
    text, tries = column.cast("string"), []
    for f in formats:
        numbers = re.fullmatch(r"[yMdHhmsS :/.-]*", f) and "MMM" not in f  # as in timestamp_sql
        fitting = F.when((F.instr(text, ".") > 0) == ("." in f), text) if numbers else text
        tries.append(F.try_to_timestamp(fitting, F.lit(f)))
    return F.coalesce(*tries)


def risk_band(score: Column) -> Column:
    return F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


# What becomes of an entry's name, in this order (pattern, replacement).
NAME_STEPS = (
    (r"(?i)\.pcap$", ""),
    (r"(?i)part\s+(\d)", "part$1"),
    (r"\s+", "-"),
    (r"-{2,}", "-"),
    (r"-+$", ""),
)


def capture_name(day: Column, entry: Column) -> Column:
    """A capture's file name: the day, then the entry's name with `part N` joined and white space as single hyphens."""
    stem = F.element_at(F.split(entry, "/"), -1)
    for pattern, by in NAME_STEPS:
        stem = F.regexp_replace(stem, pattern, by)
    return F.concat(day, F.lit("-"), stem, F.lit(".pcap"))


def file_day(path: Column) -> Column:
    """The date dd-mm-yyyy in a file name; a name without one raises."""
    text = F.regexp_extract(path, r"(\d{2}-\d{2}-\d{4})", 1)
    return F.when(text != "", F.to_date(text, "dd-MM-yyyy")).otherwise(F.raise_error(F.concat(F.lit("no date in file name: "), path)))


#: Extensions of archive entries that are no captures.
NO_CAPTURE = ("lnk", "txt", "csv", "log", "zip", "db", "ini")


def is_capture(entry: Column) -> Column:
    """Whether an archive entry is a capture: its innermost name lies under pcap/, is no folder and has no other extension."""
    name = F.element_at(F.split(entry, "!"), -1)
    return name.startswith("pcap/") & ~name.endswith("/") & ~F.lower(name).rlike(rf"\.({'|'.join(NO_CAPTURE)})$")


def contains_ignoring_case(column: Column, part: str) -> Column:
    return F.lower(column).contains(part.lower())

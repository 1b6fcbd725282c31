"""Comparison of captures as bags of packets, unions of daily tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators._columns import col


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The bag of rows as (print, n)."""
    return df.groupBy(F.xxhash64(*[col(c) for c in columns]).alias("print")).agg(F.count("*").alias("n"))


def capture_summary(df: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    """One row for a capture: rows, distinct rows, first and last time."""
    bag = df.groupBy(F.xxhash64(*[col(c) for c in columns]).alias("print")).agg(F.count("*").alias("n"), F.min(col(time)).alias("first"), F.max(col(time)).alias("last"))
    return bag.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"), F.min("first").alias("first"), F.max("last").alias("last"))


def _bag_row(prints_a: DataFrame, prints_b: DataFrame) -> DataFrame:
    a, b = prints_a.select("print", F.col("n").alias("a")), prints_b.select("print", F.col("n").alias("b"))
    n_a, n_b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, "print", "full").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("shared", F.least(n_a, n_b)), ("united", F.greatest(n_a, n_b)), ("size_a", n_a), ("size_b", n_b))]
    )


def bag_similarity(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: shared and united sizes, weighted Jaccard, and each bag's share in the other; empty bags give 1."""
    ratio = lambda x, y: F.when(F.col(y) == 0, 1.0).otherwise(F.col(x) / F.when(F.col(y) != 0, F.col(y)))
    return _bag_row(fingerprint(a, columns), fingerprint(b, columns)).select(
        "shared", "united", ratio("shared", "united").alias("similarity"), ratio("shared", "size_a").alias("a_in_b"), ratio("shared", "size_b").alias("b_in_a")
    )


def time_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared part of the united time of two ranges of numbers: 1 where it has no length, 0 where one is missing."""
    shared = F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0))
    united = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    known = start_a.isNotNull() & end_a.isNotNull() & start_b.isNotNull() & end_b.isNotNull()
    return F.when(~known, 0.0).when(united == 0, 1.0).otherwise(shared / F.when(united != 0, united))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; they must have the same columns, in any order."""
    first = set(parts[0].columns)
    if bad := [p.columns for p in parts if set(p.columns) != first]:
        raise ValueError(f"columns differ: {sorted(first)} and {bad[0]}")
    return reduce(DataFrame.unionByName, parts)

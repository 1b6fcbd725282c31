"""Reproducible sharding: a Feistel permutation of global row numbers, with cycle walking.

Row numbers follow the order of the ids. The permutation maps [0, n) onto itself and is computed, not stored: shard
and slot of any row number, and the row number at any shard and slot, follow from (n, shards, seed) alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netquarry.llm.shared import free_name, written

ROUNDS = 6
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; its constants are fixed values."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & _MASK
    x = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & _MASK
    return x ^ (x >> np.uint64(31))


class RowShuffle:
    """The permutation of [0, n) for a seed."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.low = np.uint64((1 << int(self.half)) - 1)
        self.keys = [_mixed(np.array([seed * 1_000_003 + r], dtype=np.int64).view(np.uint64))[0] for r in range(rounds)]

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for key in keys:
            left, right = right, left ^ (_mixed(right ^ key) & self.low)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for key in reversed(self.keys):
            left, right = right ^ (_mixed(left ^ key) & self.low), left
        return (left << self.half) | right

    def _walk(self, rows: np.ndarray, step) -> np.ndarray:
        x = rows.astype(np.uint64)
        with np.errstate(over="ignore"):
            x = step(x)
            while (out := x >= np.uint64(self.n)).any():  # the walk stays on the row's own cycle, so it comes back below n
                x[out] = step(x[out])
        return x.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, lambda x: self._once(x, self.keys)) if len(rows) else rows.astype(np.int64)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self._back) if len(places) else places.astype(np.int64)

    def shard_slot(self, rows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.place(rows)
        return at % shards, at // shards

    def row_at(self, shard: int, slot: int, shards: int) -> int:
        return int(self.row(np.array([slot * shards + shard]))[0])


def numbered(spark: SparkSession, df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """df with global row numbers from 0 in the given order.

    One range shuffle on (order, place in the input): the place makes every key distinct, so even a key that a third
    of all rows share is dealt over many partitions. The sorted rows are written once, with their partition and their
    place in it, and only the partitions' row counts are summed up, so a lost executor can't change a number. Null
    keys come first, rows of equal keys (repeated rows, too) in the order they are read; texts may be of any length,
    and an empty table gives an empty one. df must not have a column called name; other columns keep theirs.
    """
    part, at, tie = free_name(df, "_part", "_at", "_tie")
    placed = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, F.col(tie)]
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    dealt = dealt.withColumns(
        {part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    dealt = written(spark, dealt, "numbered")
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}  # a row per partition
    start, starts = 0, []
    for key in sorted(counts):
        starts.append((key, start))
        start += counts[key]
    before = spark.createDataFrame(starts, "_p int, _before long")
    out = dealt.join(F.broadcast(before), dealt[part] == before["_p"], "left")
    return out.withColumn(name, F.col("_before") + F.col(at)).drop(part, at, "_p", "_before")


def feistel_shards(
    spark: SparkSession, df: DataFrame, order: list[Column], shards: int = 24, seed: int = 11
) -> DataFrame:
    """df with row_number, shard and slot: the shuffled row numbers are dealt over the shards in turn.

    Shard sizes differ by one row at most and slots have no gap. Rows with equal keys, repeated rows among them, get
    numbers of their own, in the order they are read. Null keys come first. An empty table gives an empty one. A
    column that clashes with a new name makes the new one end in an underscore.
    """
    number, shard, slot = free_name(df, "row_number", "shard", "slot")
    rows = numbered(spark, df, order, number)
    n = rows.count()
    shuffle = RowShuffle(n, seed)

    @F.pandas_udf(StructType([StructField("shard", LongType()), StructField("slot", LongType())]))
    def placed(x: pd.Series) -> pd.DataFrame:
        at, into = shuffle.shard_slot(x.to_numpy(), shards)
        return pd.DataFrame({"shard": at, "slot": into})

    at = free_name(rows, "_placed")[0]
    out = rows.withColumn(at, placed(F.col(number)))
    return out.withColumns({shard: F.col(f"{at}.shard").cast("int"), slot: F.col(f"{at}.slot")}).drop(at)

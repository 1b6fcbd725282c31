"""Greedy in-order packing into batches by size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from netquarry.operators._columns import col

#: Items of a group at most.
MOST = 1_000_000


def plan_batches(sizes: Iterable[int], limit: int) -> list[int]:
    """The batch number of each item: a batch closes before the item that would exceed the limit; one may stand alone."""
    out, batch, held = [], 0, 0
    for size in sizes:
        if held and held + size > limit:
            batch, held = batch + 1, 0
        out.append(batch)
        held += size
    return out


def with_batches(df: DataFrame, order: Sequence[str], size: str, limit: int, group: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """df with batch, the batch number from 0 in the given order (nulls first), within each group. A null size counts as 0.

    The fold needs the items of a group in order: meant for inventories of files, of which a group holds thousands. A
    group of more than `most` items raises ValueError.
    """
    kind = StructType([*df.schema.fields, StructField("batch", IntegerType())])

    def fold(items: pd.DataFrame) -> pd.DataFrame:
        if len(items) > most:
            raise ValueError(f"a group has {len(items)} items, more than {most}")
        items = items.sort_values(list(order), na_position="first", kind="stable")
        return items.assign(batch=pd.Series(plan_batches(items[size].fillna(0).tolist(), limit), index=items.index, dtype="int32"))

    return df.groupBy(*[col(g) for g in group]).applyInPandas(fold, kind)

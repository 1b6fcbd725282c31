"""Fit and apply scaling on the sparse state tables, with population statistics of the training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators._columns import col

LEAST_STD, CLIP = 1e-8, 10.0


def training_windows(windows: DataFrame, ratio: float = 0.7, window: str = "window_start") -> DataFrame:
    """windows (one row each) with train: whether they are among the first int(n x ratio) in time."""
    place = F.row_number().over(Window.orderBy(window))
    n = F.count("*").over(Window.orderBy(window).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return windows.select(window).distinct().withColumn("train", place <= F.floor(n * ratio))


def fit_scaler(df: DataFrame, columns: Sequence[str], least_std: float = LEAST_STD) -> DataFrame:
    """Rows (name, mean, std): population deviation, 1 where it is below least_std; without rows mean 0 and std 1.

    The tables are sparse: a row exists just where its mask is 1, so masked places take no part.
    """
    one = df.agg(
        *[F.coalesce(F.avg(col(c).cast("double")), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.coalesce(F.stddev_pop(col(c).cast("double")), F.lit(1.0)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") < least_std, 1.0).otherwise(F.col(f"s{i}")).alias("std"))
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], clip: float = CLIP, enabled: bool = True) -> DataFrame:
    """df with columns as (x - mean) / std within +-clip. The scaler has one row per column and is turned into one row."""
    if not enabled:
        return df
    stats = scaler.filter(F.col("name").isin(list(columns))).agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("mean", "std")))).alias("_scaler")
    )
    out = df.crossJoin(F.broadcast(stats))  # one row on the other side
    scaled = {}
    for c in columns:
        s = F.col("_scaler")[c]
        scaled[c] = F.greatest(F.least((col(c).cast("double") - s["mean"]) / s["std"], F.lit(clip)), F.lit(-clip))
    return out.withColumns(scaled).drop("_scaler")


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.schema("name string, mean double, std double").parquet(path)

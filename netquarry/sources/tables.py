"""CSV, Parquet and array tables: explicit schemas in, checked appends out."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.scalars import file_day
from netquarry.session import settled


def read_csv(spark: SparkSession, path: str | Sequence[str], header: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, every column as text: types are cast where they are checked. header saves a look at the file."""
    reader = spark.read.option("header", True).option("escape", '"')
    if header is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in header)).option("enforceSchema", False)
    return reader.csv(list(path) if not isinstance(path, str) else path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str, append: bool = False) -> int:
    """Write or append CSV with a header and return the number of rows. Appending asks for an identical header."""
    spark = df.sparkSession
    if append:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) and (there := csv_header(spark, path)) != df.columns:
            raise ValueError(f"header differs: {there} and {df.columns}")
    rows = df.count()
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)
    return rows


def write_parquet(df: DataFrame, path: str, level: int = 22, mode: str = "overwrite") -> None:
    """Parquet with zstd and version 2 pages."""
    (
        df.write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", level)
        .option("parquet.writer.version", "v2")
        .parquet(path)
    )


def parquet_batches(spark: SparkSession, path: str, columns: Sequence[str] | None = None, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A Parquet table as Arrow batches of `size` rows, the last one shorter; the driver holds one, and what is read ahead.

    In a store that only Spark opens a partition at a time comes to the driver.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in _read_batches(spark, path, columns, size):
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            held, rows, batch = [*held, part], rows + part.num_rows, batch.slice(part.num_rows)
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _read_batches(spark: SparkSession, path: str, columns: Sequence[str] | None, size: int) -> Iterator[pa.RecordBatch]:
    try:
        system, inner = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, ValueError):
        df = spark.read.parquet(path)
        df = df.select(*columns) if columns else df
        rows = df.toLocalIterator(prefetchPartitions=True)
        while batch := list(itertools.islice(rows, min(size, 100_000))):
            yield pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in batch])
        return
    table = dataset.dataset(inner, filesystem=system, format="parquet", partitioning="hive")
    yield from table.to_batches(columns=list(columns) if columns else None, batch_size=min(size, 1 << 17), batch_readahead=2, fragment_readahead=1)


def chronological(df: DataFrame) -> DataFrame:
    """Rows with file_day, the date in the name of the file each came from; a name without one raises."""
    return df.withColumn("file_day", file_day(F.col("_metadata.file_name")))


def save_arrays(tensors: DataFrame, names: dict[str, Sequence[str]], path: str) -> None:
    """Tensors per window as Parquet, with the names of their features beside them as JSON."""
    tensors.write.mode("overwrite").parquet(f"{path}/arrays")
    tensors.sparkSession.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")


def load_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    names = "".join(r[0] for r in spark.read.text(f"{path}/names").collect())  # one small file
    return spark.read.parquet(f"{path}/arrays"), json.loads(names)


def save_windows(tensors: DataFrame, names: dict[str, Sequence[str]], path: str, time: str = "window_start") -> int:
    """save_arrays in order of time: shards of consecutive windows, each window with its number from 0; how many there are.

    One range shuffle deals the windows over shards; path/index tells each shard's first number and its count, a row each,
    so load_windows reads no others. A null time comes first; of windows of one time the order is as they are read.
    """
    spark = tensors.sparkSession
    tie = "_tie"
    dealt = tensors.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(time, tie).sortWithinPartitions(time, tie).drop(tie)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = settled(dealt.withColumns({"shard": F.spark_partition_id(), "_at": at}), "windows")
    index, total = [], 0
    for shard, n in sorted(map(tuple, dealt.groupBy("shard").count().collect())):  # a row per shard
        index.append((shard, total, n))
        total += n
    told = spark.createDataFrame(index, "shard int, first long, count long")
    numbered = dealt.join(F.broadcast(told.select("shard", "first")), "shard").withColumn("number", F.col("first") + F.col("_at")).drop("first", "_at")
    numbered.repartition(max(1, len(index)), "shard").sortWithinPartitions("shard", "number").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/arrays")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")
    return total


def load_windows(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The windows first to last, both ends included, by number; only the shards that hold them are read."""
    index = spark.read.parquet(f"{path}/index")
    near = [r[0] for r in index.filter((F.col("first") <= last) & (F.col("first") + F.col("count") > first)).select("shard").collect()]  # a row per shard
    return spark.read.parquet(f"{path}/arrays").filter(F.col("shard").isin(near) & F.col("number").between(first, last)).drop("shard")


def write_report(metrics: DataFrame, path: str, cycle: int) -> None:
    """Validation counts of a cycle; each cycle keeps its own folder."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/cycle={cycle}")

"""Session defaults and table access shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the paths of settled tables are noted, if anywhere.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[*]", app: str = "netquarry", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; extra settings win."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a session on a local master gets one of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: a shared folder is needed on a cluster")
        found = tempfile.mkdtemp(prefix="netquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled within are deleted at the end: for work whose result has been written by then."""
    token = _scratch.set(paths := [])
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its rows and their places stay as they are, whatever is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if (scope := _scratch.get()) is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, and a check of full bytes on hits.

Documents arrive as a file stream in micro-batches of bounded size. The state store (RocksDB, with its checkpoint in
the shared folder) keeps for every digest how many rows had it and the row that stays: its length, identifier and
content locator (file and row). It never expires, so a copy is found however late it comes. After the stream has
caught up the state is read as a table. Rows whose digest was hit more than once are compared by their full bytes (the
contents of other rows stay where they are read): a digest that stands for different contents is resolved by grouping
those rows by content. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netquarry.llm.shared import SPACE, fresh_path, join_counted, likely_in, written

#: Settings of the session that the stream runs in. Files aren't preallocated: that takes 4 MB for each state partition.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of files in a micro-batch.
BATCH_BYTES = 32 << 30
#: Settings of the caller's session that the stream's own session takes over.
SHARED_SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def squeezed(text: Column) -> Column:
    """The text without its ASCII white space; null as empty."""
    return F.coalesce(F.regexp_replace(text, f"[{SPACE}]+", ""), F.lit(""))


def sha256_digest(squeezed_text: Column) -> Column:
    return F.sha2(squeezed_text, 256)


def _located(docs: DataFrame, id_col: str, text_col: str, digest: callable) -> DataFrame:
    """(id, place, digest, content): place orders the rows of a digest, the greatest stays.

    The longest original first, then the smallest id (its bits inverted, so that null comes last), then file and row.
    """
    content = squeezed(F.col(text_col))
    place = F.struct(
        F.coalesce(F.length(text_col), F.lit(0)).alias("length"),
        F.bitwise_not(F.col(id_col)).alias("id_inverted"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return docs.select(F.col(id_col).alias("id"), place.alias("place"), digest(content).alias("digest"), content.alias("content"))


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.count("*").alias("group_size"), F.max("place").alias("stays"))


def caught_up(spark: SparkSession, path: str, id_col: str, text_col: str, digest: callable, batch_bytes: int) -> DataFrame:
    """The state after all files at path have streamed in: (digest, group_size, stays).

    The stream runs in a session of its own, so that queries beside it don't see the settings of its state store.
    """
    table = _table(spark, path, id_col, text_col)
    if table.isEmpty():  # no file may ever have come: there is no state to read
        return _counted(_located(table, id_col, text_col, digest))
    state, own = fresh_path(spark, "dedup-stream"), spark.newSession()
    for key, value in {k: spark.conf.get(k, None) for k in SHARED_SETTINGS}.items():
        if value is not None:
            own.conf.set(key, value)
    for key, value in STATE_STORE.items():
        own.conf.set(key, value)
    stream = own.readStream.schema(table.schema).option("maxBytesPerTrigger", batch_bytes).parquet(_as_glob(path))
    counted = _counted(_located(stream, id_col, text_col, digest))
    query = counted.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    stored = spark.read.format("statestore").load(state)
    return stored.select(
        F.col("key.digest").alias("digest"), F.col("value.count").alias("group_size"), F.col("value.max").alias("stays")
    )


def _table(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """The files' id and text alone: another column may have the name of the files' metadata."""
    whole = spark.read.parquet(path).schema
    return spark.read.schema(StructType([whole[id_col], whole[text_col]])).parquet(path)


def _as_glob(path: str) -> str:
    """A pattern that only the path matches: a file stream takes a folder or a pattern, and this may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stream_dedup(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: callable = sha256_digest,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row for each row of the Parquet files at path: (id, digest, keep_id, group_size, kept).

    Texts are equal when they are the same without ASCII white space; null counts as empty. Of equal texts the row
    with the most code points in the original stays, then the smallest id; null ids come last, and of fully repeated
    rows just one stays, by file and row. Ids are integers. An empty table gives an empty one; other columns play no part,
    whatever their names.
    """
    state = written(spark, caught_up(spark, path, id_col, text_col, digest, batch_bytes), "dedup-state")
    table = _table(spark, path, id_col, text_col)
    rows = written(spark, _located(table, id_col, text_col, digest).select("id", "place", "digest"), "dedup-rows")
    joined = written(spark, join_counted(rows, state, ["digest"], "group_size"), "dedup-joined")
    # only contents of digests that were hit are made and dealt out; copies collapse where they are read
    hit = joined.filter("group_size > 1").select(F.xxhash64("place.file", "place.row").alias("at"))
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("at")
    contents = likely_in(table.select(F.col(text_col).alias("text"), place), "at", hit).select(squeezed(F.col("text")).alias("content"))
    contents = contents.select(digest(F.col("content")).alias("digest"), "content").distinct()
    mixed = written(spark, contents.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-mixed")
    if mixed.isEmpty():
        return _decided(joined).withColumnRenamed("id", id_col)
    apart = _located(table, id_col, text_col, digest).join(mixed, "digest", "left_semi")
    by_content = apart.groupBy("digest", "content").agg(F.count("*").alias("group_size"), F.max("place").alias("stays"))
    resolved = apart.join(by_content, ["digest", "content"]).select("id", "place", "digest", "group_size", "stays")
    return _decided(joined.join(mixed, "digest", "left_anti")).unionByName(_decided(resolved)).withColumnRenamed("id", id_col)


def _decided(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        "digest",
        F.bitwise_not(F.col("stays.id_inverted")).alias("keep_id"),
        "group_size",
        F.col("place").eqNullSafe(F.col("stays")).alias("kept"),
    )

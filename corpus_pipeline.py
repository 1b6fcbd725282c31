"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing and sharding, each stage a written table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents, whatever further ones docs has; made columns that clash with one get another name.
Each stage takes null, empty and very long texts, null and repeated ids, repeated rows and empty tables; what becomes
of them is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import bktree_simhash, decontaminate, mixing, quality_model, sharding
from netquarry.llm.shared import free_name, removed, temporary, text_of, utf8_crc32

#: A document stays if it reaches grade 1 with at least this probability.
KEEP_TAIL = 0.5
SHARDS = 24
#: Rows at most that go to a Python worker at once; texts may be long, and a batch is held by the JVM and the worker alike.
BATCH = 500


def _in_small_batches(stage: Callable) -> Callable:
    """A stage whose tables go to Python workers in batches of BATCH rows at most: for this session, as its result is read later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(size)) <= BATCH:
            spark.conf.set(size, BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rates acceptable; those it rejects go. Fitted on rated rows of docs itself.

    Null and empty texts have the score 0 and stay or go by where the thresholds lie; repeated rows fare alike. Without
    labels, or with one grade only, all have the same score and stay.
    """
    model = quality_model.train(spark, docs, quality_model.quality_grades(_table(spark, sf_dir, "labels")), 3)
    (mark,) = free_name(docs, "graded")
    return quality_model.graded(docs, model, name=mark).filter(F.col(f"{mark}.tail") >= KEEP_TAIL).drop(mark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8.

    Null and empty texts are one group, of repeated rows one stays; the smallest id stays, null last.
    """
    return bktree_simhash.first_of_each(spark, docs, similarity=0.8, shingle=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item within its edit budget.

    Null and empty texts stay, repeated rows fare alike, null and empty items are ignored.
    """
    return decontaminate.without_leaks(spark, docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: a part counts as the whole from half the words on.

    Null and empty texts have no words and are never taken; rows of equal id and text are taken alike.
    """
    found = mixing.mix(spark, docs, F.array(docs["source"]), mixing.cyclic_weights((5, 2, 1))).documents
    size, copies, part = (next(c for c in found.columns[len(docs.columns) :] if c.startswith(n)) for n in ("size", "copies", "part"))
    times = F.col(copies) + ((F.col(part) > 0) & (F.col(part) * 2 >= F.col(size))).cast("int")
    (number,) = free_name(found, "_pass")
    again = found.withColumn(number, F.explode(F.array_repeat(F.lit(1), times)))
    return again.select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its number, shard and slot in a reproducible shuffled order.

    Rows are numbered by id, null first, and the checksum of the text (null as empty), equal ones as they are read.
    """
    order = [F.col("doc_id"), utf8_crc32(text_of(docs))]
    return sharding.feistel_shards(spark, docs, order, SHARDS)


STAGES = [
    ("quality", _in_small_batches(quality)),
    ("near_duplicates", _in_small_batches(near_duplicates)),
    ("benchmark_leaks", _in_small_batches(benchmark_leaks)),
    ("source_mix", _in_small_batches(source_mix)),
    ("shards", _in_small_batches(shards)),
]

#: The first two stages and the mix have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents. A stage's tables are deleted once its result, and that one once the next is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            removed(spark, before)
        before = docs
    return docs

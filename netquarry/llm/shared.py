"""Helpers that the corpus operators share: the shared folder, written tables, components of a link table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word.
SPACE = r"\x20\x09-\x0D"
#: Where the paths of written tables are noted, if anywhere.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
#: Keys at most that a join by count broadcasts.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent a temporary folder serves, in local mode only; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is not set: a shared folder is needed on a cluster")
        found = tempfile.mkdtemp(prefix="netquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no recomputation."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written within are deleted at the end, but for those written by the function that this yields."""
    outer, paths = _scope.get(), []
    token = _scope.set(paths)

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = written(spark, df, name)
        path = paths.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield kept
    finally:
        _scope.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that `written` made and that no later plan reads."""
    for df in tables:
        _delete(spark, df.__dict__["_written_at"])


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names near the wanted ones that no column of df has, letters in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[name], F.lit(""))


def join_counted(left: DataFrame, right: DataFrame, key: list[str], counted: str, how: str = "left") -> DataFrame:
    """left joined with right (a row for each key), where right's column `counted` says how many rows of left have the key.

    A key of more than one in HOT_KEYS of left's rows would overload the task it is dealt to. There are HOT_KEYS of
    those at most, so they are joined by broadcast, where left's rows lie; the others are dealt by key. Both tables
    are read more than once: they should be written ones.
    """
    total, most = right.agg(F.sum(counted), F.max(counted)).first()
    if (most or 0) * HOT_KEYS <= (total or 0):
        return left.join(right, key, how)
    is_hot = F.col(counted) > total / HOT_KEYS
    hot = right.filter(is_hot)
    cold = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(right.filter(~is_hot), key, how))


def join_salted(
    spark: SparkSession, left: DataFrame, right: DataFrame, key: str, uses: DataFrame | None = None, each: int = 256
) -> DataFrame:
    """left joined with right (a row for each key), whose rows may be too large to broadcast.

    A key that left has more than `each` times is dealt over as many salts as it takes, and right's row is repeated
    for each of them. uses: (key, count) of left's rows, where they are known; else left should be a written table.
    """
    uses = left.groupBy(key).count() if uses is None else uses
    many = written(spark, uses.filter(F.col("count") > each).withColumn("_salts", F.ceil(F.col("count") / each).cast("int")), "salts")
    others = [c for c in left.columns if c != key]
    salted = join_counted(left, many, [key], "count").withColumn(
        "_salt", F.pmod(F.xxhash64(*others), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    spread = right.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return salted.drop("count", "_salts").join(spread.drop("count", "_salts"), [key, "_salt"]).drop("_salt")


def likely_in(df: DataFrame, key: str, keys: DataFrame, bits: int = 26) -> DataFrame:
    """df's rows whose key may be among keys (a column of that name): all that are, and some that are not.

    The keys become a bitmap of 2^bits bits in pieces of 4 KB, so at most 8 MB are broadcast however many keys there
    are; with very many of them more of the other rows come through.
    """
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    held = keys.select((at / 32768).cast("int").alias("_piece"), (at % 32768).alias("_bit"))
    held = held.groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    marked = df.withColumns({"_piece": (at / 32768).cast("int"), "_bit": (at % 32768).cast("int")})
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = marked.join(F.broadcast(held), "_piece").filter(F.getbit(byte, F.col("_bit") % 8) == 1)
    return found.select(*df.columns)


def with_likely(df: DataFrame, key: str, keys: DataFrame, name: str, bits: int = 26) -> DataFrame:
    """df with a boolean column: whether the row's key (a long) may be among keys, as in likely_in; rows stay where they are."""
    piece, bitmap = free_name(df, "_piece", "_bitmap")
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    held = keys.select((at / 32768).cast("int").alias(piece), (at % 32768).alias("_bit"))
    held = held.groupBy(piece).agg(F.bitmap_construct_agg("_bit").alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, (at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn(piece, (at / 32768).cast("int")).join(F.broadcast(held), piece, "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(piece, bitmap)


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, root) with root the smallest node reachable.

    Alternating large-star and small-star steps on edges. Each step takes minima by node with map-side partials and
    joins them back by the number of edges, so that the edges of a node with very many of them stay where they are.
    Every step is a written table; it ends when a round changes nothing. Nodes that have no link to another node are
    absent. Raises RuntimeError if rounds steps don't settle it.
    """
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(spark, pairs, "links")
    before = _digest(edges)
    for _ in range(rounds):
        # large star: every larger neighbour hangs on the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        low = written(spark, low.filter("n > 0").select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n"), "links-low")
        large = join_counted(edges, low, ["v"], "n", "inner").select("u", F.col("m").alias("v"))
        large = written(spark, large.filter("u <> v").distinct(), "links-large")
        # small star: the smaller neighbours and the node itself hang on the smallest neighbour
        least = written(spark, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "links-least")
        small = join_counted(large, least, ["u"], "n", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = written(spark, small, "links")
        removed(spark, edges, low, large, least)
        edges, found = after, _digest(after)
        if found == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("root")))
        before = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)

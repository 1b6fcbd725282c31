"""Importance resampling towards a target's distribution of hashed word n-grams, with an exact distributed draw.

Every bucket of hashed features has a gain, the log ratio of its share in the target texts to its share in the
documents. A document's weight is the mean gain of its features, taken from an array of the gains; Gumbel noise that
follows from the seed and the id alone turns the draw without replacement into a choice of the highest scores. The
k-th composite key (score, id) is found by radix selection: each pass counts one 16-bit digit of the keys that share
the digits found so far, so that 65,536 counts reach the driver, however many documents there are. Only rows up to that
key are sorted by range and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.sharding import numbered
from netquarry.llm.shared import text_of, written

#: A-Z in lower case; all ASCII but letters and digits as a blank. What isn't ASCII is part of a word.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in (c + 32 if 65 <= c <= 90 else c for c in range(256)))
DIGIT = 16


def features(text: str, longest: int) -> tuple[int, np.ndarray]:
    """The number of words, and the CRC-32 of each run of 1 to longest consecutive words, joined by one space."""
    words = text.encode().translate(WORD_BYTES).split()
    if not words:
        return 0, np.zeros(0, dtype=np.int64)
    spaced = [b" " + w for w in words[1:]]
    level = list(map(crc32, words))
    out = [np.fromiter(level, dtype=np.int64, count=len(level))]
    for k in range(longest - 1):
        level = list(map(crc32, spaced[k:], level))
        out.append(np.fromiter(level, dtype=np.int64, count=len(level)))
    return len(words), np.concatenate(out)


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: partitions count, the driver gets a number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(text.as_py(), longest)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(text_of(texts, text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in `want` over that in `have`."""
    n = len(have)
    have_all, want_all = float(have.sum()) + n, float(want.sum()) + n
    ratio = ((want + 1.0) * have_all) / ((have + 1.0) * want_all)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight (the floored mean gain of the features, 0 without any) for the text."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                n, found = features(text.as_py(), longest)
                rows.append((n, len(found), int(gains[found % len(gains)].sum()) // len(found) if len(found) else 0))
            made = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], names=["n_words", "n_features", "weight", *rest])

    fields = ["n_words long, n_features long, weight long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)]
    return docs.select(text_of(docs, text_col).alias("text"), *rest).mapInArrow(run, ", ".join(fields))


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 x Gumbel noise) from the first 32 bits of the SHA-256 of `seed:id`; a null id is empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def kth_key(rows: DataFrame, columns: Sequence[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest (from 1) of the rows' keys, which are long columns in order of weight; None if rows are fewer.

    Radix selection from the highest digit: each pass counts one digit of the rows whose keys begin like the one that
    is looked for. Digits that all rows share, by the columns' least and largest values, take no pass.
    """
    ends = rows.agg(F.count("*"), *[f(c) for c in columns for f in (F.min, F.max)]).first()
    if not 1 <= k <= ends[0]:
        return None
    found: list[int] = []
    here, offset, low_bits = rows, 1 << 63, (1 << DIGIT) - 1
    for i, name in enumerate(columns):
        low, high = (x + offset for x in ends[1 + 2 * i : 3 + 2 * i])
        shift = -(-(low ^ high).bit_length() // DIGIT) * DIGIT  # above it all keys agree
        value = low >> shift << shift
        while shift:
            shift -= DIGIT
            digit = F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(-offset)), shift).bitwiseAND(F.lit(low_bits))
            counts = sorted(map(tuple, here.groupBy(digit.alias("digit")).count().collect()))
            for at, n in counts:
                if k <= n:
                    break
                k -= n
            value |= at << shift
            here = here.filter(F.col(name).between(value - offset, (value | ((1 << shift) - 1)) - offset))
            if n == 1:  # the only row left is the one
                return tuple(here.select(*columns).first())
        found.append(value - offset)
        here = here.filter(F.col(name) == found[-1])
    return tuple(found)


def resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 25,
    least_words: int = 20,
    buckets: int = 10_000,
    longest: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank, from 1, of the drawn ones, else null.

    Words are runs of letters and digits (A-Z lower-cased; whatever isn't ASCII is part of a word), features all runs of
    1 to longest words, counted over all whole texts of docs and of target (a column named like text_col). Of the rows
    with least_words words the given percentage, rounded down, is drawn: those of the highest scores, of equal ones
    those of the smallest ids, null last, of one id those with the fewest features. Ids are whole numbers.

    Null and empty texts have no features and weight 0, and aren't drawn while least_words is positive. Repeated rows
    get a row each and may be drawn each. Empty tables are fine: without a target all buckets are weighed against equal
    shares. Very long texts are counted whole; columns of other names play no part.
    """
    have = bucket_counts(docs, buckets, longest, text_col)
    want = bucket_counts(target, buckets, longest, text_col)
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = weighted(slim, bucket_gains(have, want), longest).withColumn("score", F.col("weight") + noise("id", seed))
    keys = {"k0": -F.col("score"), "k1": F.col("id").isNull().cast("long"), "k2": F.coalesce("id", F.lit(0).cast("long")), "k3": F.col("n_features")}
    rows = written(spark, rows.withColumns(keys), "resample-scored")
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    last = kth_key(able, list(keys), drawn)
    if last is None:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    within = (F.col("n_words") >= least_words) & (F.struct(*keys) <= F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(keys, last, strict=True)]))
    order = [F.col(c) for c in keys]
    ranked = numbered(spark, rows.filter(within), order, "rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.select(*shown, "rank").unionByName(rows.filter(~within).select(*shown, F.lit(None).cast("long").alias("rank")))

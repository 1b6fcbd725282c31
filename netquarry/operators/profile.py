"""Profiling: repeated headers, summaries, negative and constant columns, correlations, distinct values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators._columns import col

#: Ranks that a sketch errs by are a share of one in ACCURACY of the rows.
ACCURACY = 10_000
PERFECT, VERY_HIGH, HIGH = 0.9999995, 0.95, 0.90


def is_header(df: DataFrame) -> Column:
    """Whether a row repeats the header in all columns."""
    return reduce(lambda a, b: a & b, [col(c).cast("string").eqNullSafe(F.lit(c)) for c in df.columns])


def header_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(is_header(df)).alias("repeated_headers"))


def numeric_view(df: DataFrame, strings: Sequence[str] = ()) -> DataFrame:
    """Without repeated headers, all columns but strings as numbers; text that is none becomes null."""
    return df.filter(~is_header(df)).select(*[col(c) if c in strings else col(c).try_cast("double").alias(c) for c in df.columns])


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all present and finite."""
    good = F.lit(True)
    for c in columns:
        v = col(c).cast("double")
        good = good & v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))
    return df.filter(good)


def _long(one: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """A row per column from one wide row of aggregates named <field><i>."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(n) for n, p in fields.items()]) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, std (sample), min, exact quartiles, max; NaN and text that is no number count as missing.

    Two passes without a shuffle of rows. The first takes the moments and, from mergeable sketches, a narrow bracket
    around each quartile; the second counts what lies below each bracket and how often each value in it comes. So the
    quartiles are exact, and no task holds more than one bracket's values. The result is made when this is called.
    """
    spark, quarters = df.sparkSession, (0.25, 0.5, 0.75)
    number = [col(c).try_cast("double") for c in columns]
    view = df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(number)])
    near = [max(min(q + d * 2 / ACCURACY, 1.0), 0.0) for q in quarters for d in (-1, 1)]
    first = []
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        sketch = F.percentile_approx(c, F.array(*[F.lit(x) for x in near]), F.lit(ACCURACY))
        first.append(F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), sketch.alias("near")))
    summary = list(view.agg(*[f.alias(f"s{i}") for i, f in enumerate(first)]).first())  # one row
    brackets = [(i, k, s["near"][2 * k], s["near"][2 * k + 1]) for i, s in enumerate(summary) if s["n"] for k in range(len(quarters))]
    picked = _order_statistics(view, {(i, k): (low, high, quarters[k] * (summary[i]["n"] - 1)) for i, k, low, high in brackets})
    rows = [(c, s["n"], s["mean"], s["std"], s["low"], *[picked.get((i, k)) for k in range(3)], s["high"]) for i, (c, s) in enumerate(zip(columns, summary, strict=True))]
    kinds = ", ".join(f"{n} double" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return spark.createDataFrame(rows, f"column string, count long, {kinds}")


def _order_statistics(view: DataFrame, brackets: dict[tuple[int, int], tuple[float, float, float]]) -> dict[tuple[int, int], float]:
    """Interpolated order statistics of the columns c0, c1 ...: (column, number) to (low, high, place from 0).

    The values at a place and at the next one lie in [low, high], or are the nearest beyond it.
    """
    if not brackets:
        return {}
    below = [F.count_if(F.col(f"c{i}") < low) for (i, _), (low, _, _) in brackets.items()]
    before = [F.max(F.when(F.col(f"c{i}") < low, F.col(f"c{i}"))) for (i, _), (low, _, _) in brackets.items()]
    above = [F.min(F.when(F.col(f"c{i}") > high, F.col(f"c{i}"))) for (i, _), (_, high, _) in brackets.items()]
    ends = view.agg(*below, *before, *above).first()  # one row
    inside = F.array(
        *[
            F.when(F.col(f"c{i}").between(low, high), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"c{i}").alias("v")))
            for (i, k), (low, high, _) in brackets.items()
        ]
    )
    counted = view.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.k", "x.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i", "k").orderBy("v"))
    n = len(brackets)
    wanted = view.sparkSession.createDataFrame(
        [(i, k, ends[j], int(place)) for j, ((i, k), (_, _, place)) in enumerate(brackets.items())], "i int, k int, below long, at long"
    )
    reach = F.col("below") + F.col("upto")
    found = counted.withColumn("upto", upto).join(F.broadcast(wanted), ["i", "k"]).groupBy("i", "k").agg(
        F.min(F.when(reach > F.col("at"), F.col("v"))).alias("a"), F.min(F.when(reach > F.col("at") + 1, F.col("v"))).alias("b")
    )
    values = {(r["i"], r["k"]): (r["a"], r["b"]) for r in found.collect()}  # a row per bracket
    out = {}
    for j, (key, (_, _, place)) in enumerate(brackets.items()):
        at, part = int(place), place - int(place)
        if at < ends[j] - 1:
            raise RuntimeError(f"a bracket of column {key[0]} lies too high")
        a, b = values[key]
        a = ends[n + j] if at < ends[j] else ends[2 * n + j] if a is None else a
        b = ends[2 * n + j] if b is None else b
        out[key] = a + (b - a) * part if part else a
    return out


def negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and count of negative values, where there are any."""
    one = df.agg(*[F.count_if(col(c) < 0).alias(f"n{i}") for i, c in enumerate(columns)])
    return _long(one, columns, {"negative_count": "n"}).filter("negative_count > 0")


def negative_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and each distinct negative value."""
    return distinct_values(df, columns).filter("value < 0")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value) of the distinct values as numbers; one unpivot and one aggregation."""
    return df.select(*[col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").distinct()


def constants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and value of columns that hold one value only."""
    one = df.agg(
        *[F.min(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(columns)],
    )
    return _long(one, columns, {"value": "a", "_high": "b"}).filter("value = _high").drop("_high")


def maxima(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df.agg(*[F.max(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]), columns, {"maximum": "m"})


class CoMoments:
    """Counts, means, squared deviations and co-deviations of all pairs of columns, each over the rows that have both.

    Entry (a, b) of mean and square is of column a where b is present. Blocks merge, in any order.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, cross: np.ndarray, odd: np.ndarray):
        self.parts = (n, mean, square, cross, odd)

    @classmethod
    def of(cls, values: np.ndarray) -> CoMoments:
        """A block: rows of doubles, of which `values` is a masked array. Products of whole matrices, about each column's own mean."""
        present, data = ~np.ma.getmaskarray(values), np.ma.getdata(values)
        finite = np.isfinite(data)
        odd, here = (present & ~finite).astype(float), present.astype(float)
        use = present & finite
        low, high = (f(np.where(use, data, fill), axis=0) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
        count = use.sum(axis=0)
        centre = np.where(count == 0, 0.0, np.where(low == high, low, np.where(use, data, 0.0).sum(axis=0) / np.maximum(count, 1)))
        x = np.where(use, data - centre, 0.0)
        n = here.T @ here
        sums = x.T @ here
        least = np.maximum(n, 1)
        square = np.maximum((x * x).T @ here - sums * sums / least, 0.0)
        return cls(n, centre[:, None] + sums / least, square, x.T @ x - sums * sums.T / least, odd.T @ here)

    def merged(self, other: CoMoments) -> CoMoments:
        n, mean, square, cross, odd = self.parts
        m, mean2, square2, cross2, odd2 = other.parts
        total = np.maximum(n + m, 1)
        apart = np.where((n > 0) & (m > 0), mean2 - mean, 0.0)
        weight = n * m / total
        return CoMoments(
            n + m, np.where(n > 0, mean, mean2) + apart * m / total, square + square2 + apart * apart * weight, cross + cross2 + apart * apart.T * weight, odd + odd2
        )

    def correlation(self) -> np.ma.MaskedArray:
        """r of each pair; masked without a row that has both, NaN for a constant or where a value isn't finite."""
        n, _, square, cross, odd = self.parts
        with np.errstate(all="ignore"):
            r = cross / np.sqrt(square * square.T)
        return np.ma.masked_array(np.where(odd + odd.T > 0, np.nan, r), n == 0)

    def packed(self) -> bytes:
        return np.stack(self.parts).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, width: int) -> CoMoments:
        return cls(*np.frombuffer(data).reshape(5, width, width))


def correlations(df: DataFrame, columns: Sequence[str], *, block: int = 8192, fan_in: int = 64) -> DataFrame:
    """Rows (a, b, r): Pearson correlation of each pair of columns, in the order given, over the rows that have both.

    Each partition makes one CoMoments of its rows, block by block as products of matrices; fan_in tasks merge these and
    one merges theirs. So the plan doesn't grow with the columns, and what is shuffled not with the rows.
    """
    width = len(columns)
    slim = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[CoMoments]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                piece = batch.slice(k, block).columns
                data = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in piece], axis=1)
                yield CoMoments.of(np.ma.masked_array(data, np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in piece], axis=1)))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[CoMoments]:
        for batch in batches:
            for x in batch.column(0):
                yield CoMoments.unpacked(x.as_py(), width)

    def merging(read: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = reduce(CoMoments.merged, read(batches), CoMoments(*np.zeros((5, width, width))))
            yield pa.RecordBatch.from_arrays([pa.array([found.packed()], pa.binary())], names=["m"])

        return run

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                a, b = np.triu_indices(width, 1)
                r = CoMoments.unpacked(x.as_py(), width).correlation()[a, b]
                names = [pa.array([columns[i] for i in end], pa.string()) for end in (a, b)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.ma.getdata(r), mask=np.ma.getmaskarray(r))], names=["a", "b", "r"])

    parts = slim.mapInArrow(merging(blocks), "m binary").repartition(fan_in)
    one = parts.mapInArrow(merging(stored), "m binary").repartition(1).mapInArrow(merging(stored), "m binary")
    return one.mapInArrow(shown, "a string, b string, r double")


def correlation_report(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Rows (category, place, a, b, r): perfect, very_high, high and high_negative pairs.

    A category without pairs shows the `top` pairs in its order instead, marked fallback.
    """
    pairs = correlations(df, columns).filter(F.col("r").isNotNull() & ~F.isnan("r"))
    tests = {
        "perfect": F.col("r") >= PERFECT,
        "very_high": (F.col("r") >= VERY_HIGH) & (F.col("r") < PERFECT),
        "high": (F.col("r") >= HIGH) & (F.col("r") < VERY_HIGH),
        "high_negative": F.col("r") <= -HIGH,
    }
    each = F.array(*[F.struct(F.lit(n).alias("category"), t.alias("_in"), (F.col("r") if n == "high_negative" else -F.col("r")).alias("_key")) for n, t in tests.items()])
    wide = pairs.select("a", "b", "r", F.explode(each).alias("c")).select("a", "b", "r", "c.*")
    by = Window.partitionBy("category")
    ranked = wide.withColumn("_any", F.max(F.col("_in").cast("int")).over(by)).withColumn(
        "place", F.row_number().over(by.orderBy(F.col("_in").desc(), "_key", "a", "b"))
    )
    kept = ranked.filter(F.col("_in") | ((F.col("_any") == 0) & (F.col("place") <= top)))
    return kept.select("category", "place", "a", "b", "r", (~F.col("_in")).alias("fallback"))

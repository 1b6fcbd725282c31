"""Audit of how filters interact: what each removes, in every order, from a packed bitmap index.

Every partition packs its rows into bitsets: one for each filter (the rows that fail it), one for each mark, and the
rows of each part as a span of whole 64-bit words. The rows that survive a set of filters are an AND-NOT of bitsets,
counted by popcount over each part's span. The counts of all subsets of the filters are summed over the partitions,
and every order, step and average over orders follows from these sums: 2^filters numbers for each part, however many
rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import SPACE, join_counted, text_of, written

#: Rows that are packed into one set of bitmaps at most.
BLOCK = 1 << 17
#: Filters at most: the result has a row for each of their orders.
MOST_FILTERS = 7


def subset_counts(rows: DataFrame, part: str, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """(part, subset, kept, one count for each mark): what passes all filters of a subset, a bit for each filter.

    rows: part (text), a boolean column for each filter, true where a row fails it, and one for each mark. A null flag
    counts as false, a null part as empty text. Every part has a row for each subset, also where nothing is kept.
    """
    width, names = len(filters), ["part", "subset", "kept", *marks]

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        parts = coded.dictionary
        size = np.bincount(code, minlength=len(parts))
        words = -(-size // 64)
        start = np.concatenate(([0], np.cumsum(words)[:-1]))
        order = np.argsort(code, kind="stable")
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) + 64 * np.repeat(start, size)

        def packed(flags: np.ndarray) -> np.ndarray:
            bits = np.zeros(64 * int(words.sum()), dtype=bool)
            bits[at] = flags[order]
            return np.packbits(bits, bitorder="little").view(np.uint64)

        flag = [packed(c.to_numpy(zero_copy_only=False).astype(bool)) for c in batch.columns[1:]]
        alive = {0: packed(np.ones(len(code), dtype=bool))}
        found: list[list[np.ndarray]] = [[] for _ in range(1 + len(marks))]
        for subset in range(1 << width):
            if subset:
                last = subset.bit_length() - 1
                alive[subset] = alive[subset ^ (1 << last)] & ~flag[last]
            for k, kept in enumerate([alive[subset], *[alive[subset] & m for m in flag[width:]]]):
                found[k].append(np.add.reduceat(np.bitwise_count(kept).astype(np.int64), start))
        subsets = np.repeat(np.arange(1 << width, dtype=np.int32), len(parts))
        repeated = pa.concat_arrays([parts] * (1 << width))
        return pa.RecordBatch.from_arrays([repeated, pa.array(subsets), *[pa.array(np.concatenate(c)) for c in found]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
        if n:
            yield counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *marks)]
    slim = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags)
    fields = ", ".join(["part string, subset int, kept long", *[f"`{m}` long" for m in marks]])
    found = slim.mapInArrow(run, fields)
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", *marks)])


def order_audit(counts: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from subset_counts.

    kept: rows after the step; removed: rows that go in it; redundant: rows that fail its filter but went before;
    unique_fails: rows that fail this filter alone; <mark>_lost: marked rows that go in it; shapley: removed, summed
    over the filter's step in all orders.
    """
    n = len(filters)
    orders = list(permutations(range(n)))
    steps = [(order, k) for order in orders for k in range(n)]
    before = np.array([sum(1 << f for f in order[:k]) for order, k in steps])
    own = np.array([order[k] for order, k in steps])
    names = ["".join(filters[f] for f in order) for order, _ in steps]
    step = np.array([k + 1 for _, k in steps], dtype=np.int32)
    whole = (1 << n) - 1
    subsets = np.arange(1 << n)
    sizes = np.bitwise_count(subsets)
    weights = np.array([factorial(int(s)) * factorial(n - 1 - int(s)) if s < n else 0 for s in sizes], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept, *marked = (np.array([e[c] for e in entries], dtype=np.int64) for c in ("kept", *marks))
                after = before | (1 << own)
                removed = kept[before] - kept[after]
                fails = np.array([kept[0] - kept[1 << f] for f in range(n)])
                alone = np.array([kept[whole ^ (1 << f)] - kept[whole] for f in range(n)])
                value = []
                for f in range(n):
                    free = subsets[(subsets >> f) & 1 == 0]
                    value.append(int(weights[free] @ (kept[free] - kept[free | (1 << f)])))
                columns = [
                    pa.array([part] * len(steps), pa.string()), pa.array(names, pa.string()), pa.array(step), pa.array(kept[after]), pa.array(removed),
                    pa.array(fails[own] - removed), pa.array(alone[own]), *[pa.array(m[before] - m[after]) for m in marked],
                    pa.array(np.array(value, dtype=np.int64)[own]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=shown)

    shown = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    fields = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in shown[3:])
    entry = F.struct("subset", "kept", *marks)
    gathered = counts.groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # 2^filters entries a part
    return gathered.mapInArrow(run, fields)


def audit(rows: DataFrame, part: str, filters: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """order_audit of the subset_counts of rows: see there. Filters are named by their boolean columns.

    An empty table gives an empty one; repeated rows count each; columns that aren't named play no part. More than
    MOST_FILTERS filters raise ValueError.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters are compared, not {len(filters)}")
    return order_audit(subset_counts(rows, part, filters, marks), filters, marks)


def text_flags(text: Column) -> dict[str, Column]:
    """The filters A to D on a whole text without nulls, true where it fails.

    A: under 50 words; B: fewer than 65 distinct words of a hundred; C: more than 5 letters A-Z of a hundred code
    points; D: any of # $ % & * and the bar. Words end at ASCII white space, letters in either case differ.
    """
    blanks = " \t\n\x0b\x0c\r"
    inner = F.btrim(text, F.lit(blanks))
    words = F.when(inner != "", F.split(inner, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < 50,
        "B": kinds * 100 < n * 65,
        "C": capitals * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of docs: five filters on whole texts and two marks from labels.

    E: the text equals that of a row with a smaller id, anywhere in docs (told by SHA-256). Null and empty texts are
    equal; a row without an id neither fails E nor makes another fail it, and of rows with one id and text none does for
    the other. good: a label of the id has quality 1; toxic: one has toxic 1. A null part is the empty one. Repeated
    rows get a row each, texts may be of any length, other columns play no part, empty tables are fine.
    """
    text = text_of(docs, text_col)
    slim = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        *[c.alias(n) for n, c in text_flags(text).items()],
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    slim = written(spark, slim, "audit-rows")
    repeated = slim.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    repeated = written(spark, repeated, "audit-repeated")
    rows = join_counted(slim, repeated, ["digest"], "copies")
    rows = rows.select("id", "part", *"ABCD", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E"))
    is_one = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False)))
    marks = labels.groupBy(labels[id_col].alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    known = rows.filter("id is not null").join(marks.filter("good or toxic"), "id", "left")
    unknown = rows.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(unknown).drop("id")

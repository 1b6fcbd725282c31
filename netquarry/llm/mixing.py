"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

Documents are aggregated by the set of sources they belong to (their pattern). A flow on the small graph
pattern -> source routes words to the source quotas; a pattern's words cost nothing the first time and more for
each repetition (convex), so repetition is used only where a quota can't be met otherwise. The flow is integral
and is solved on the driver over at most max_patterns patterns, whatever the number of documents; rarer patterns than those
are served through the smallest of their sources.

Documents are then selected by seed: within a pattern they fall in cells of (size class, seeded bucket). Size
classes go from large to small; each takes the same share of its words, in bucket order and by whole cells, and
hands what is left over to the next smaller class. What is left in the end is less than any cell that isn't taken,
and comes as a part of the smallest of those: its documents give their first words, in proportion. So what the mix
takes of each pattern meets its flow, but for rounding, also where one document is most of a source; documents of all
lengths are represented alike; and no task orders the documents of a source.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import SPACE, free_name, written

#: Cost of a word's first, second, third ... passage through the mix; it must not fall.
PASS_COSTS = (0, 1, 3)
BUCKETS = 1024
#: Patterns up to which the plan is broadcast.
BROADCAST_PATTERNS = 64


@dataclass(frozen=True)
class Mix:
    """The documents with their columns taken, source_size and target, and the small tables behind them."""

    documents: DataFrame
    quotas: dict
    routed: dict

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Targets that share the total of sizes by weight, none above most times its size; the excess is reshared.

    A source of size 0 gets 0. Where even most times every size can't hold the total (most < 1), all are at the limit.
    """
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        free -= set(over)
    return targets


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximum flow, by successive shortest paths."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for u, v, capacity, price in arcs:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            head[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
    potential = [0] * n
    while True:
        far, via = [None] * n, [-1] * n
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in head[u]:
                if room[e] > 0:
                    v, nd = to[e], d + cost[e] + potential[u] - potential[to[e]]
                    if far[v] is None or nd < far[v]:
                        far[v], via[v] = nd, e
                        heapq.heappush(queue, (nd, v))
        if far[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        furthest = max(d for d in far if d is not None)
        potential = [p + (furthest if d is None else d) for p, d in zip(potential, far, strict=True)]
        push, v = None, sink
        while v != source:
            push = room[via[v]] if push is None else min(push, room[via[v]])
            v = to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def route(patterns: dict[tuple, int], quotas: dict, costs: Sequence[int] = PASS_COSTS) -> dict[tuple, dict]:
    """Words of each pattern (a tuple of sources, with its words) that go to each source's quota."""
    names, keys = list(quotas), list(patterns)
    node = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    arcs, where = [], []
    for i, key in enumerate(keys):
        for price in costs:
            arcs.append((0, 2 + i, patterns[key], price))
            where.append(None)
        for s in key:
            arcs.append((2 + i, node[s], patterns[key] * len(costs), 0))
            where.append((key, s))
    for s in names:
        arcs.append((node[s], 1, quotas[s], 0))
        where.append(None)
    routed: dict[tuple, dict] = {key: {} for key in keys}
    for at, flow in zip(where, min_cost_flow(2 + len(keys) + len(names), arcs, 0, 1), strict=True):
        if at:
            routed[at[0]][at[1]] = flow
    return routed


def _cells_taken(passes: int) -> callable:
    """For one pattern's cells, how many whole passages each gets, and the words of a part of one more."""

    def take(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["size_class", "bucket"], ascending=[False, True]).reset_index(drop=True)
        words = cells["words"].tolist()
        flow, total = int(cells["flow"].iloc[0]), sum(words)
        whole = min(flow // total, passes) if total else 0
        left, below = (flow - whole * total if whole < passes else 0), total
        extra, part = [0] * len(words), [0] * len(words)
        for _, at in cells.groupby("size_class", sort=False).groups.items():
            own = sum(words[i] for i in at)
            share, run = (left * own / below if below else 0.0), 0
            for i in at:
                # a cell goes in if it fits and brings the class nearer to its share
                if 0 < words[i] <= left - run and abs(run + words[i] - share) <= abs(run - share):
                    extra[i], run = 1, run + words[i]
            left, below = left - run, below - own
        for i, n in enumerate(words):
            if not extra[i] and 0 < n <= left:
                extra[i], left = 1, left - n
        if left:
            smallest = min((i for i, n in enumerate(words) if n and not extra[i]), key=lambda i: (words[i], i))
            part[smallest] = left
        copies = [(whole + x) if n else 0 for x, n in zip(extra, words, strict=True)]
        return cells.assign(copies=copies, part=part)[["pattern_id", "size_class", "bucket", "words", "copies", "part"]].astype(
            {"pattern_id": "int32", "size_class": "int32", "bucket": "int32", "copies": "int32"}
        )

    return take


def mix(
    spark: SparkSession,
    docs: DataFrame,
    members: Column,
    weights: callable,
    *,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 3,
    costs: Sequence[int] = PASS_COSTS,
    buckets: int = BUCKETS,
    max_patterns: int = 4096,
) -> Mix:
    """The mix of docs: each row with size, copies (whole passages), part (first words of one more), taken (words, both
    counted) and mix_sources, the target and size of each of its sources.

    members: array of the sources a document belongs to; null entries are a source of their own. weights: from the
    sorted list of sources (code points, null last) to their weights. Sources share the words of all documents by
    weight, none above most times its share of them (its own words, where sources don't overlap). A document in
    several sources counts in the size of each, and its words may go to either quota.

    The flow knows at most max_patterns patterns. Where there are more, those with the fewest words are served through
    the smallest of their sources alone: every document is still mixed and quotas are met as before, only the choice
    between those sources is lost. More than half as many sources raise ValueError.

    A null or empty text has size 0 and is never taken. Rows of equal id and text fall in the same cell and are taken
    alike. An empty table gives an empty one. Ties don't arise: the seed, the id and the text decide. Reruns agree.
    Columns of docs keep their names; where one clashes with a column made here, the made one gets a trailing underscore.
    """
    if list(costs) != sorted(costs) or len(costs) != most:
        raise ValueError("costs must not fall, and there is one for each of the passages allowed")
    size, pattern, klass, bucket, copies, part, taken, shown = free_name(
        docs, "size", "pattern", "size_class", "bucket", "copies", "part", "taken", "mix_sources"
    )
    sized = docs.withColumns(
        {
            size: word_count(docs[text_col]),
            pattern: F.array_sort(F.array_distinct(members)),
            # by id and text: rows without an id are dealt over the buckets as well
            bucket: F.pmod(F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]), F.lit(buckets)).cast("int"),
        }
    ).withColumn(klass, F.when(F.col(size) > 0, F.floor(F.log2(F.col(size).cast("double")))).otherwise(-1).cast("int"))
    slim = sized.select(*[F.col(c).alias(n) for c, n in ((pattern, "pattern"), (klass, "size_class"), (bucket, "bucket"), (size, "words"))])
    cells = written(
        spark, slim.groupBy("pattern", "size_class", "bucket").agg(F.sum("words").alias("words")), "mix-cells"
    )
    totals = written(spark, cells.groupBy("pattern").agg(F.sum("words").alias("words")), "mix-patterns")
    own = totals.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words"))
    found = own.limit(max_patterns // 2 + 1).collect()
    if len(found) > max_patterns // 2:
        raise ValueError(f"more than {max_patterns // 2} sources")
    by_source = {r["source"]: r["words"] for r in found}
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [by_source[s] for s in names]
    total = totals.agg(F.sum("words")).first()[0] or 0
    targets = source_targets([s * total / max(sum(sizes), 1) for s in sizes], weights(names), most) if names else []
    quotas = {s: round(t) for s, t in zip(names, targets, strict=True)}
    # one row, of at most max_patterns / 2 sources
    facts = spark.createDataFrame(
        [({_key(s): (t, n) for s, t, n in zip(names, targets, sizes, strict=True)},)], "_facts map<string,struct<target:double,source_size:long>>"
    )
    fact = lambda s: F.col("_facts")[F.coalesce(F.concat(F.lit("="), s), F.lit(""))]
    sized, served = sized.crossJoin(F.broadcast(facts)), pattern
    if totals.limit(max_patterns + 1).count() > max_patterns:
        (served,) = free_name(sized, "served")
        largest = totals.orderBy(F.desc("words"), F.xxhash64("pattern")).limit(max_patterns - len(names))
        largest = written(spark, largest.select(F.col("pattern").alias("_large")), "mix-largest")
        smallest = lambda p: F.array(F.array_min(F.transform(p, lambda s: F.struct(fact(s)["source_size"], s.isNull(), s.alias("s"))))["s"])

        def through(df: DataFrame, p: str, name: str) -> DataFrame:
            known = df.join(F.broadcast(largest), df[p].eqNullSafe(largest["_large"]), "left")
            return known.withColumn(name, F.coalesce("_large", smallest(F.col(p)))).drop("_large")

        sized = through(sized, pattern, served)
        cells = through(cells.crossJoin(F.broadcast(facts)), "pattern", "pattern").groupBy("pattern", "size_class", "bucket")
        cells = written(spark, cells.agg(F.sum("words").alias("words")), "mix-cells")
        totals = cells.groupBy("pattern").agg(F.sum("words").alias("words"))
    patterns = {tuple(r["pattern"]): r["words"] for r in totals.collect()}  # at most max_patterns rows
    order = sorted(patterns, key=lambda key: [(s is None, s or "") for s in key])
    routed = route({key: patterns[key] for key in order}, quotas, costs)
    # at most max_patterns rows: this small table is broadcast
    flows = spark.createDataFrame(
        [(i, list(key), sum(routed[key].values())) for i, key in enumerate(order)],
        "pattern_id int, pattern array<string>, flow long",
    )
    by_cell = (
        cells.join(F.broadcast(flows), cells["pattern"].eqNullSafe(flows["pattern"]))
        .select("pattern_id", "size_class", "bucket", "words", "flow")
        .groupBy("pattern_id")
        .applyInPandas(_cells_taken(most), "pattern_id int, size_class int, bucket int, words long, copies int, part long")
    )
    by_cell = written(spark, by_cell.filter("copies > 0 or part > 0"), "mix-taken")
    ids = flows.select(F.col("pattern_id").alias("_p0"), F.col("pattern").alias("_pattern"))
    out = sized.join(F.broadcast(ids), sized[served].eqNullSafe(ids["_pattern"]), "left")
    entry = F.struct("copies", "part", "words")
    if len(order) <= BROADCAST_PATTERNS:
        # proven bound: that many patterns x 63 size classes, a map of at most `buckets` entries each
        arrays = by_cell.groupBy("pattern_id", "size_class").agg(F.map_from_entries(F.collect_list(F.struct("bucket", entry))).alias("by_bucket"))
        plan = written(spark, arrays, "mix-plan").select(F.col("pattern_id").alias("_p"), F.col("size_class").alias("_k"), "by_bucket")
        out = out.join(F.broadcast(plan), (out["_p0"] == plan["_p"]) & (out[klass] == plan["_k"]), "left")
        got = F.try_element_at(F.col("by_bucket"), F.col(bucket))
    else:
        # cell by cell, so the documents of one pattern and size are dealt over its buckets
        plan = by_cell.select(F.col("pattern_id").alias("_p"), F.col("size_class").alias("_k"), F.col("bucket").alias("_mix_bucket"), entry.alias("_mix_cell"))
        out = out.join(plan, (out["_p0"] == plan["_p"]) & (out[klass] == plan["_k"]) & (out[bucket] == plan["_mix_bucket"]), "left")
        got = F.col("_mix_cell")
    first = F.when(got["part"] > 0, F.floor(F.col(size).cast("decimal(38,0)") * got["part"] / got["words"]).cast("long"))
    out = out.withColumns({copies: F.coalesce(got["copies"], F.lit(0)), part: F.coalesce(first, F.lit(0))})
    out = out.withColumn(taken, F.col(size) * F.col(copies) + F.col(part))
    sources = F.transform(pattern, lambda s: F.struct(s.alias("source"), fact(s)["target"].alias("target"), fact(s)["source_size"].alias("source_size")))
    return Mix(out.select(*[F.col(c) for c in (*docs.columns, size, copies, part, taken)], sources.alias(shown)), quotas, routed)


def _key(source: str | None) -> str:
    return "" if source is None else f"={source}"


def cyclic_weights(values: Sequence[float]) -> callable:
    """Weights that repeat along the sorted sources."""
    return lambda names: [values[i % len(values)] for i in range(len(names))]

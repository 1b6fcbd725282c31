"""SimHash near-duplicates: fingerprints searched in BK-trees, sharded so that no tree depends on the corpus size.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints link when they differ
in at most `radius` bits; documents are grouped by the connected components of the links.

Distinct fingerprints are dealt to shards by some of their bits. With the blocks of `exact_bands` two fingerprints
within the radius agree on all bits of at least one band (pigeonhole), so searching each shard's tree alone loses
no link. The children of a BK-tree's node are keyed by their integer Hamming distance to it, and a search follows
only the edges within the radius of its own distance. Trees are built where their shard lies instead of being
broadcast, since together they grow with the corpus. A shard of far more than `most` fingerprints is dealt anew by
bands of its other bits, if the bands are exact; one of more than `most` is split into chunks, one tree for each pair
of chunks. A shard yields links that span its groups, never all pairs.

Near-duplicates by the similarity of shingle sets take longer fingerprints. The radius and the bands find candidates,
of which each shard yields those that span its groups, the closest first; a link counts if the sets of its two texts
are as similar as asked. What a shard doesn't yield is tested in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import components, free_name, join_counted, join_salted, likely_in, text_of, with_likely, written

SEED = 42
SPREAD = np.uint64(0x0101010101010101)
#: Fingerprints in a tree at most, and pairs of (query, node) that a search holds at once.
MOST, FRONTIER = 4096, 200_000
#: A shard of so many times MOST fingerprints is dealt anew by its other bits.
AGAIN = 16
#: Shingles that are hashed at once.
PIECE = 100_000
#: Texts whose hashes a worker holds at once.
SLICE = 500
#: Pairs of sets that are tested at once, and bytes of sets in a tree at most.
TESTED, SET_BYTES = 128, 1 << 25


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    words = text.encode().lower().split()  # on bytes both touch ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts, ends = np.concatenate(([0], ends[:-shingle])), ends[shingle - 1 :] - 1
    out = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(out), PIECE):  # a very long text's places aren't lists as a whole
        places = zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist(), strict=True)
        out[k : k + PIECE] = [digest(joined[a:b], SEED) for a, b in places]
    return out


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits made from each hash; the first are the hash itself. Constants of murmur3's finaliser."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of `counts` hashes, the word of bits that over half of the run has; 0 for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    pieces = -(-n // 255)  # a byte holds the sum of 255 bits
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    found = np.zeros(len(full), dtype=np.uint64)
    for b in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & SPREAD, cuts)
        by_bit = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            found |= (by_bit[:, byte] * 2 > n).astype(np.uint64) << np.uint64(8 * byte + b)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, text_col: str = "text") -> DataFrame:
    """docs with fp, 8 x lanes bytes, in the place of the text column; repeated shingles count as often as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            hashes = [shingle_hashes(t or "", shingle) for t in batch.column(0).to_pylist()]
            counts = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
            flat = np.concatenate(hashes)
            words = np.stack([majority(lane(flat, k), counts) for k in range(lanes)], axis=1).astype(">u8")
            packed = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(8 * lanes), len(words), [None, pa.py_buffer(np.ascontiguousarray(words).tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    rest = [c for c in docs.columns if c != text_col]
    fields = ", ".join(["fp binary", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)])
    return docs.select(text_of(docs, text_col).alias("text"), *rest).mapInArrow(run, fields)


def exact_bands(n: int, radius: int, bits: int = 64) -> list[list[int]]:
    """Sets of bit positions: any two fingerprints within the radius agree on the whole of at least one.

    bits in radius + t blocks, every t of which make a band: radius changed bits leave t blocks alone. The t of the
    least estimated work for n fingerprints is taken; each is exact.
    """
    best = None
    for t in range(1, 5):
        blocks = np.array_split(np.arange(bits), radius + t)
        bands = [np.concatenate(x).tolist() for x in combinations(blocks, t)]
        work = sum(200 + n / 2.0 ** len(b) for b in bands)
        if best is None or work < best[0]:
            best = (work, bands)
    return best[1]


def drawn_bands(bits: int, width: int, differing: float, missed: float, seed: int = 3) -> list[list[int]]:
    """Bands of `width` bits each, drawn from all bits in turn.

    So many that, where each bit differs with the probability `differing`, all of them hold a differing bit with the
    probability `missed` at most, as far as they don't share bits.
    """
    rng, left, bands = np.random.default_rng(seed), [], []
    for _ in range(math.ceil(math.log(missed) / math.log(1 - (1 - differing) ** width))):
        band: list[int] = []
        while len(band) < width:
            left = left or rng.permutation(bits).tolist()
            bit = left.pop()
            if bit not in band:
                band.append(bit)
        bands.append(band)
    return bands


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over the rows of words, one tree for each run of equal group numbers (0, 0, 1, 1, 1 ...)."""

    def __init__(self, words: np.ndarray, group: np.ndarray):
        self.words = words
        self.root = np.searchsorted(group, group)  # the first row of a group is its tree's root
        n = len(words)
        parent, self.edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        open_, at = np.flatnonzero(self.root != np.arange(n)), None
        at = self.root[open_]
        while len(open_):  # a level of all trees at once
            d = distance(words[open_], words[at])
            _, first, inverse = np.unique(at * (words.shape[1] * 64 + 1) + d, return_index=True, return_inverse=True)
            child = open_[first]
            parent[child], self.edge[child] = at[first], d[first]
            rest = np.ones(len(open_), dtype=bool)
            rest[first] = False
            open_, at = open_[rest], child[inverse[rest]]
        order = np.argsort(parent, kind="stable")
        self.children = order[np.searchsorted(parent[order], 0) :]
        self.first = np.searchsorted(parent[self.children], np.arange(n))
        self.count = np.searchsorted(parent[self.children], np.arange(n), side="right") - self.first

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, row of the same tree within the radius), level by level."""
        q, node = queries, self.root[queries]
        while len(q):
            d = distance(self.words[q], self.words[node])
            hit = d <= radius
            yield q[hit], node[hit]
            more = self.count[node]
            offset = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            child = self.children[np.repeat(self.first[node], more) + offset]
            follow = np.abs(self.edge[child] - np.repeat(d, more)) <= radius
            q, node = np.repeat(q, more)[follow], child[follow]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of near, for so many queries at once that the search stays within FRONTIER."""
        sizes = np.bincount(self.root, minlength=len(self.words))[self.root]
        many = np.flatnonzero(sizes > 1)
        cut = np.cumsum(sizes[many]) // FRONTIER
        for k in np.unique(cut):
            yield from self.near(many[cut == k], radius)

    def groups(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (row, first row of its tree that links of at most `radius` bits reach)."""
        label = np.arange(len(self.words))
        for a, b in self.pairs(radius):
            merge(label, a, b)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return linked, label[linked]

    def closest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of at most `radius` bits that span the groups with the least distances (a minimum spanning forest)."""
        none = np.zeros(0, dtype=np.int64)
        a, b, held_a, held_b, held = none, none, [], [], 0
        for x, y in self.pairs(radius):
            once = x < y
            held_a.append(x[once])
            held_b.append(y[once])
            held += int(once.sum())
            if held > FRONTIER:  # the forest of all pairs is that of the forest so far and the pairs since
                a, b = self._spanning(np.concatenate([a, *held_a]), np.concatenate([b, *held_b]))
                held_a, held_b, held = [], [], 0
        return self._spanning(np.concatenate([a, *held_a]), np.concatenate([b, *held_b]))

    def nearest(self, radius: int, each: int, allowed: callable) -> tuple[np.ndarray, np.ndarray]:
        """Allowed pairs of at most `radius` bits, of which each row has `each` of its closest at least, or all it has.

        self.lacking: which rows lack some of their allowed pairs. Every pair that is left out has two such ends.
        """
        a = b = np.zeros(0, dtype=np.int64)
        self.lacking = np.zeros(len(self.words), dtype=bool)
        held_a, held_b, held = [], [], 0
        for x, y in self.pairs(radius):
            once = x < y
            once[once] = allowed(x[once], y[once])
            held_a.append(x[once])
            held_b.append(y[once])
            held += int(once.sum())
            if held > FRONTIER:
                a, b = self._nearest(np.concatenate([a, *held_a]), np.concatenate([b, *held_b]), each)
                held_a, held_b, held = [], [], 0
        return self._nearest(np.concatenate([a, *held_a]), np.concatenate([b, *held_b]), each)

    def _nearest(self, a: np.ndarray, b: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        ends, away = np.concatenate((a, b)), np.tile(distance(self.words[a], self.words[b]), 2)
        order = np.lexsort((away, ends))
        of = ends[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = np.unique(order[rank < each] % max(1, len(a)))
        left_out = np.ones(len(a), dtype=bool)
        left_out[keep] = False
        self.lacking[a[left_out]] = self.lacking[b[left_out]] = True
        return a[keep], b[keep]

    def joining(self, radius: int, group: np.ndarray, allowed: callable, close: callable) -> tuple[np.ndarray, np.ndarray]:
        """Links that join the groups as all allowed pairs of at most `radius` bits that pass close(row, row) do."""
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        label, found = first[inverse], [np.zeros((2, 0), dtype=np.int64)]
        for x, y in self.pairs(radius):
            once = x < y
            once[once] = allowed(x[once], y[once])
            order = np.argsort(distance(self.words[x[once]], self.words[y[once]]), kind="stable")
            x, y = x[once][order], y[once][order]
            for k in range(0, len(x), TESTED):  # pairs that earlier ones have joined need no test
                i, j = x[k : k + TESTED], y[k : k + TESTED]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                passed = np.fromiter(map(close, i.tolist(), j.tolist()), dtype=bool, count=len(i))
                found.append(np.stack((i[passed], j[passed])))
                merge(label, i[passed], j[passed])
        return tuple(np.concatenate(found, axis=1))

    def _spanning(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(distance(self.words[a], self.words[b]), kind="stable")
        a, b = a[order], b[order]
        label, alive, chosen = np.arange(len(self.words)), np.arange(len(a)), []
        while True:  # every group takes its first link to another one
            x, y = label[a[alive]], label[b[alive]]
            apart = x != y
            alive, x, y = alive[apart], x[apart], y[apart]
            if not len(alive):
                break
            first = np.full(len(label), len(a))
            np.minimum.at(first, x, alive)
            np.minimum.at(first, y, alive)
            chosen.append(np.unique(first[first < len(a)]))
            merge(label, a[chosen[-1]], b[chosen[-1]])
        picked = np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
        return a[picked], b[picked]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each pair, and all rows that they were joined with, the smallest of their labels."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (nearer := label[label]).tolist() != label.tolist() if len(label) < 64 else not np.array_equal(nearer := label[label], label):
            label[:] = nearer


def enough(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, each in order, have a Jaccard similarity of at least `least`."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= (len(x) + len(y) - common) * least


def shard_links(radius: int, closest: bool, least: float | None = None, each: int = 0) -> callable:
    """Over rows (shard, fp, node) sorted by shard: links (a, b) of nodes that span the groups of each shard, the closest if asked.

    least: a node is followed by its set's size and sketch and a number of its group. Then pairs come of which the groups
    differ and sizes and sketches allow the similarity, of each node at least the `each` closest, and of each that lacks some
    a pair with itself. each 0: the set itself follows, and links come that join the groups as all similar pairs do.
    """

    def tree_links(shards: list, fps: list, nodes: list) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(len(fps), -1)
        keys = np.array(shards, dtype=np.int64)
        forest = Forest(words, np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1]))))
        if least is None:
            ends = forest.closest(radius) if closest else forest.groups(radius)
        else:
            facts = np.frombuffer(b"".join(n[16:64] for n in nodes), dtype="<i8").reshape(len(nodes), 6)
            sets = None if each else [np.frombuffer(n, dtype=np.uint64, offset=64) for n in nodes]
            nodes = [n[:16] for n in nodes]
            group, size, sketch = facts[:, 5], facts[:, 0], np.ascontiguousarray(facts[:, 1:5]).view(np.uint64)

            def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                x, y = size[i], size[j]
                near = (group[i] != group[j]) & (np.minimum(x, y) >= np.maximum(x, y) * (least - 1e-9))
                return near & (distance(sketch[i], sketch[j]) * (1 + least) <= (x + y) * (1 - least + 1e-9))

            def close(i: int, j: int) -> bool:
                return enough(sets[i], sets[j], least)

            if each:
                a, b = forest.nearest(radius, each, allowed)
                lacking = np.flatnonzero(forest.lacking)
                ends = np.concatenate((a, lacking)), np.concatenate((b, lacking))
            else:
                ends = forest.joining(radius, group, allowed, close)
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in end], pa.binary()) for end in ends], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for batch in batches:
            for rows, column in zip(held, batch.columns, strict=True):
                rows += column.to_pylist()
            keep = len(held[0])  # the last shard may go on in the next batch
            while keep and held[0][keep - 1] == held[0][-1]:
                keep -= 1
            if keep:
                yield tree_links(*[rows[:keep] for rows in held])
                held = [rows[keep:] for rows in held]
        if held[0]:
            yield tree_links(*held)

    return run


def _deal(bands: list[list[int]], within: list[list[list[int]]] | None = None) -> callable:
    """(band, key, fp, node) for every band of each node; within: the bands that a row of a former band gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["band", "key", "fp", "node"]
        for batch in batches:
            fp = batch.column(batch.schema.get_field_index("fp"))
            bits = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), dtype=np.uint8).reshape(len(fp), -1), axis=1)
            key_of = lambda at: bits[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))  # noqa: B023, E731
            rest = [fp, batch.column(batch.schema.get_field_index("node"))]
            if within is None:
                for k, at in enumerate(bands):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, dtype=np.int32)), pa.array(key_of(at)), *rest], names=names)
                continue
            former = batch.column(batch.schema.get_field_index("band")).to_numpy()
            for k in np.unique(former):
                mine = np.flatnonzero(former == k)
                whole = key_of(bands[k])[mine]
                for j, at in enumerate(within[k]):
                    # the former band and its key are part of the new key: no shard mixes two of them
                    key = (whole * 1_000_003 + k) * 1_000_003 + j
                    key = (key * 0x2545F4914F6CDD1D) ^ key_of(at)[mine]
                    band = np.full(len(mine), len(bands) + j, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(key), *[c.take(pa.array(mine)) for c in rest]], names=names)

    return run


def links(
    spark: SparkSession, nodes: DataFrame, bands: list[list[int]], radius: int, most: int = MOST, *, closest: bool = False, exact: bool = True, least: float | None = None, each: int = 0
) -> DataFrame:
    """Links (a, b) between nodes (node, fp), that span the groups of each shard; see shard_links.

    exact: the bands lose no link of the radius, and neither may those of very large shards, which are dealt anew.
    """
    fields = "band int, key long, fp binary, node binary"
    dealt = nodes.select("fp", "node").mapInArrow(_deal(bands), fields)
    whole = F.sum(F.length("node")) if least is not None and not each else F.lit(0)

    def large(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("band", "key").agg(F.count("*").alias("count"), whole.alias("bytes"))
        return written(spark, sizes.filter((F.col("count") > most) | (F.col("bytes") > SET_BYTES)), "simhash-large")

    counts = large(dealt)
    huge = counts.filter(F.col("count") > AGAIN * most).select("band", "key")
    if exact and not huge.isEmpty():
        bits = 1 + max(max(b) for b in bands)
        within = []
        for band in bands:
            others = np.array(sorted(set(range(bits)) - set(band)))
            within.append([others[b].tolist() for b in exact_bands(AGAIN * most, radius, len(others))])
        anew = dealt.join(huge, ["band", "key"], "left_semi").mapInArrow(_deal(bands, within), fields)
        dealt = written(spark, dealt.join(huge, ["band", "key"], "left_anti").unionByName(anew), "simhash-dealt")
        counts = large(dealt)
    chunks = F.coalesce(F.ceil(F.greatest(F.col("count") / most, F.col("bytes") / SET_BYTES)), F.lit(1)).cast("int")
    cut = dealt.join(counts, ["band", "key"], "left").withColumn("chunks", chunks)
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    shard = F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other"))
    # two shards whose numbers collide share a tree: more is compared, and a link is a link by its distance alone
    sharded = cut.select(shard.alias("shard"), "fp", "node").repartition("shard").sortWithinPartitions("shard", "node")
    return sharded.mapInArrow(shard_links(radius, closest, least, each), "a binary, b binary")


def simhash_groups(
    spark: SparkSession,
    docs: DataFrame,
    *,
    shingle: int = 4,
    lanes: int = 1,
    bands: list[list[int]] | None = None,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row (id, fp, component_id) for each row of docs: component_id is the smallest id reachable.

    Words are lower-cased in A-Z and end at ASCII white space; a text of fewer words than a shingle has one shingle,
    a null or empty one none and fingerprint zero, linked like any other. bands None: the exact ones for the number
    of distinct fingerprints. Repeated rows and repeated ids get a row each; a null id never is the smallest unless
    all of its group are null. An empty table gives an empty one; other columns of docs play no part.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = written(spark, fingerprints(slim, shingle, lanes), "simhash-marked")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = written(spark, nodes.withColumn("node", F.col("fp")), "simhash-nodes")
    if bands is None:
        bands = exact_bands(nodes.count(), radius, 64 * lanes)
    found = written(spark, links(spark, nodes, bands, radius), "simhash-links")
    roots = written(spark, components(spark, found), "simhash-roots")
    placed = written(spark, nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-placed")
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    firsts = written(spark, firsts, "simhash-firsts")
    # the rows of a fingerprint and the fingerprints of a component may be very many: both joins go by count
    placed = written(spark, join_counted(placed, firsts, ["root"], "members").select("fp", "n", "component_id"), "simhash-named")
    return join_counted(marked, placed, ["fp"], "n").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_sets(slim: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """slim (text and more) with hashes, the text's distinct shingle hashes, node, a name for that set, size, sketch and fp.

    hashes are 64-bit words in order, as bytes: an array column would cost the JVM a step for every element. sketch: for
    256 buckets of the hashes whether each has an odd number of them, as bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            sets = [np.unique(shingle_hashes(t or "", shingle)) for t in batch.column(0).to_pylist()]
            counts = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            flat = np.concatenate(sets)
            words = np.stack([majority(lane(flat, k), counts) for k in range(lanes)], axis=1).astype(">u8")
            packed = [x.tobytes() for x in sets]
            hashes, node = pa.array(packed, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary())
            fp = pa.array([w.tobytes() for w in words], pa.binary())
            bucket = np.repeat(np.arange(len(sets)), counts) * 256 + (lane(flat, 99) & np.uint64(255)).astype(np.int64)
            odd = np.packbits(np.bincount(bucket, minlength=256 * len(sets)).astype(np.uint8) & 1).view(np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, 4, dtype=np.int32)), pa.array(odd))
            made = [hashes, node, pa.array(counts), sketch, fp]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], names=["hashes", "node", "size", "sketch", "fp", *batch.schema.names[1:]])

    rest = [c for c in slim.columns if c != "text"]
    fields = ", ".join(["hashes binary, node binary, size long, sketch array<long>, fp binary", *(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in rest)])
    return slim.select("text", *rest).mapInArrow(run, fields)


def _little_endian(number: Column) -> Column:
    """The eight bytes of a long, the lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(number, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(8)])


def may_be_similar(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes (node, size, sketch) that sizes and sketches don't rule out: sketches differ in no more than the sets do."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.struct("size", "sketch").alias(f"_{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    x, y = F.col("_a.size"), F.col("_b.size")
    apart = sum(F.bit_count(F.col("_a.sketch")[i].bitwiseXOR(F.col("_b.sketch")[i])) for i in range(4))
    # a bound of whole numbers, widened by what doubles err
    kept = both.filter((F.least(x, y) >= F.greatest(x, y) * (least - 1e-9)) & (apart * (1 + least) <= (x + y) * (1 - least + 1e-9)))
    return kept.select(*pairs.columns)


def similar(spark: SparkSession, pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have a Jaccard similarity of at least `least`.

    Sets are joined to pairs by salted keys, so a node with very many pairs is not gathered in one task.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = likely_in(sets.select("node", "hashes"), "node", wanted).groupBy("node").agg(F.first("hashes").alias("hashes"))
    held = written(spark, held, "simhash-sets")
    one = join_salted(spark, pairs.select(F.col("a").alias("node"), "b"), held, "node")
    one = one.select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("hashes").alias("left"))
    both = join_salted(spark, one, held, "node", written(spark, pairs.groupBy(F.col("b").alias("node")).count(), "simhash-uses"))
    both = both.select("a", F.col("node").alias("b"), "left", "hashes")

    def unpacked(packed: pa.BinaryScalar) -> np.ndarray:
        return np.frombuffer(packed.as_py(), dtype=np.uint64) if packed.as_py() else np.zeros(0, np.uint64)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(enough(unpacked(left), unpacked(right), least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(close, "a binary, b binary")


def first_of_each(
    spark: SparkSession,
    docs: DataFrame,
    *,
    similarity: float = 0.8,
    shingle: int = 5,
    lanes: int = 5,
    width: int | None = None,
    each: int = 16,
    missed: float = 0.005,
    deviations: float = 2.33,
    most: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs without near-duplicates: one row of each group stays, that with the smallest id (null last).

    Texts link if the Jaccard similarity J of their sets of shingles is `similarity` or more, which is checked for
    each candidate link by the sets themselves (of 64-bit hashes); groups are the components of the links. No row
    goes without a chain of such links to the row that stays.

    Candidates come from fingerprints of 64 x lanes bits over distinct shingles, so that a line's repeats don't
    outweigh the rest. J makes a cosine of about 2J / (1 + J), and each bit differs with the probability acos(cosine)
    / pi. The radius lies `deviations` standard deviations beyond the mean for J = similarity, and all bands hold a
    differing bit with the probability `missed`: a pair at the very limit is missed by about 1 % each, closer ones far
    less. width, the bits of a band, sets the shards' size; without it 2^width is the number of sets over 1000, 2^14 at
    least, and the number of bands follows so that no more is missed.

    A shard yields candidates that span its groups, the closest first. Of a dense family most of these may be no links. So
    the sets that have a candidate are dealt once more, with their sizes, a sketch of 256 bits that differs in no more than
    they do, and their groups so far. There only pairs of different groups that sizes and sketches allow to be similar are
    candidates, and each set has the `each` closest of every shard tested by joins. Sets that have more candidates in a shard
    are dealt a third time, whole: a shard tests all that is left of them in its own task and yields the links that join
    groups. So no candidate is dropped, and a family yields no more rows than its number.

    Texts without words are copies of each other. Rows with the same id and other texts are told apart by a hash of
    the text; of fully repeated rows one stays. Columns keep their names and order; an empty table gives an empty one.
    """
    differing = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * lanes
    radius = int(bits * differing + deviations * math.sqrt(bits * differing * (1 - differing)))
    mark = F.xxhash64(text_of(docs, text_col))
    slim = docs.select(text_of(docs, text_col).alias("text"), F.col(id_col).alias("id"), mark.alias("mark"))
    marked = written(spark, shingle_sets(slim, shingle, lanes), "simhash-marked")
    order = F.struct(F.col("id").isNull().alias("x"), "id", "mark")
    # whole groups of copies collapse by partial aggregation before anything is joined
    counted = marked.groupBy("node", "fp", "size", "sketch", "id", "mark").agg(F.count("*").alias("n"))
    nodes = counted.groupBy("node", "fp", "size", "sketch").agg(F.min_by(F.struct("id", "mark", "n"), order).alias("first"))
    nodes = written(spark, nodes, "simhash-nodes")
    bands = drawn_bands(bits, width or max(14, (nodes.count() // 1000).bit_length()), differing, missed)
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = links(spark, nodes.select("node", "fp"), bands, radius, most, closest=True, exact=False)
    found = written(spark, found.select(*ordered).distinct(), "simhash-found")
    facts = nodes.select("node", "size", "sketch")
    pairs = written(spark, may_be_similar(found, facts, similarity), "simhash-pairs")
    sure = written(spark, similar(spark, pairs, marked, similarity), "simhash-links")
    roots = written(spark, components(spark, sure), "simhash-roots")
    told = [F.col("size"), *(F.col("sketch")[i] for i in range(4)), F.xxhash64(F.coalesce("root", "node"))]
    named = F.concat("node", *[_little_endian(x) for x in told])
    ends = written(spark, found.select(F.col("a").alias("node")).union(found.select("b")).distinct(), "simhash-ends")
    apart = nodes.join(ends, "node", "left_semi").join(roots, "node", "left").select("fp", named.alias("node"))
    apart = links(spark, written(spark, apart, "simhash-apart"), bands, radius, most, exact=False, least=similarity, each=each)
    apart = written(spark, apart.select(*ordered).distinct(), "simhash-nearest")
    pairs = written(spark, may_be_similar(apart.filter("a <> b"), facts, similarity), "simhash-pairs")
    if not pairs.isEmpty():
        sure = sure.unionByName(written(spark, similar(spark, pairs, marked, similarity), "simhash-links"))
        roots = written(spark, components(spark, sure), "simhash-roots")
    # pairs beyond the closest are tested where they meet
    over = apart.filter("a = b").select(F.col("a").alias("node"))
    if not over.isEmpty():
        held = likely_in(marked.select("node", "hashes"), "node", over).groupBy("node").agg(F.first("hashes").alias("hashes"))
        rest = nodes.join(over, "node", "left_semi").join(held, "node").join(roots, "node", "left").select("fp", F.concat(named, "hashes").alias("node"))
        rest = links(spark, written(spark, rest, "simhash-rest"), bands, radius, most, exact=False, least=similarity)
        sure = sure.unionByName(written(spark, rest.select(*ordered).distinct(), "simhash-links"))
        roots = written(spark, components(spark, sure), "simhash-roots")
    placed = nodes.select("node", "first.*").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.groupBy("root").agg(F.min_by(F.struct("id", "mark", "n"), order).alias("first"))
    firsts = written(spark, firsts.select("first.*"), "simhash-kept")
    here, there, number, key = free_name(docs, "_mark", "_kept", "_n", "_key")
    # rows that may go, or come more than once, are few: the others stay where they are
    hashed = lambda i, m: F.xxhash64(i, m)
    told = marked.select(hashed(F.col("id"), F.col("mark")).alias(key))
    settled = firsts.filter("n = 1").select(hashed(F.col("id"), F.col("mark")).alias(key))
    doubtful = told.groupBy(key).count().join(settled, key, "left_anti").select(key)
    flag = free_name(docs, "_doubtful")[0]
    flagged = with_likely(docs.withColumn(key, hashed(docs[id_col], mark)), key, written(spark, doubtful, "simhash-doubtful"), flag)
    stays = firsts.select(F.col("id").alias(there), F.col("mark").alias(here), F.col("n").alias(number))
    rows = flagged.filter(F.col(flag)).drop(flag, key)
    kept = rows.join(stays, rows[id_col].eqNullSafe(stays[there]) & (F.xxhash64(text_of(rows, text_col)) == stays[here]))
    sure_rows = flagged.filter(~F.col(flag)).select(*docs.columns)
    once = kept.filter(F.col(number) == 1).select(*docs.columns)
    again = kept.filter(F.col(number) > 1).dropDuplicates([there, here]).select(*docs.columns)
    return sure_rows.unionByName(once).unionByName(again)

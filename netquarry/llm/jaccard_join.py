"""Exact Jaccard self-join of shingle sets by partitions of the token universe, a pigeonhole over whole segments.

Tokens are hashes of shingles. A hash deals the universe into the segments of a size band: two sets of that band whose
similarity reaches the limit differ in at most H tokens, so of H + 1 segments at least one holds the same subset in
both. Every set is filed under the subset of each of its segments, in its own band and, where a similar larger set may
lie in the next ones, in those too.

Subsets that very many sets share (empty segments, common passages) cost the most. Allocation is by cost: a set spends
nothing on such segments and, to reach H + 1 all the same, twice as much on as many of its others. There it looks for
subsets that differ in one token too: its own subset less each token, among the others' subsets, and its own subset
among the others' less one token (the one-deletion neighbourhoods). A set most of whose segments are common can't make
up for them; it is found by the others, and such sets meet each other in 3 H + 1 finer segments, of which a similar pair
shares 2 H + 1 at least. There each of them spends nothing on its 2 H commonest: by one order of all subsets, of those
that two sets share the rarest is among the H + 1 rarest of both.

Bands of large sets have an eighth more segments than that, and so a similar pair meets that much more often: by the
same count, what a set spends on its segments beyond what differs in them adds up to the surplus and one. Pairs that meet less
often share a passage, no more, and aren't verified.

What is found is verified by the whole sets. Copies of a set are one node from the start. Groups of one subset don't
become all pairs: each set is first tested against the one centre that most of its groups name; what then still lies in
different components of one group meets in tasks, the rest of a group against its largest component. Tasks yield the pairs
that sizes and sketches allow; a group that has many of them yields a forest of them first, and what then still lies in
different components meets once more, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.llm.sharding import _mixed
from netquarry.llm.shared import components, join_counted, join_salted, likely_in, removed, temporary, text_of, written

#: Sets of the next band are at most so many times as large.
BAND = 1.5
#: A subset that more sets share costs too much where another segment can make up for it.
COMMON = 8
#: Bits of the bitmaps that tell workers which subsets matter: 8 MB each, however many subsets there are.
BITS = 26
#: Tokens that are dealt at once.
SLICE = 100_000
#: Odd multipliers of the hashes of words and of runs of words.
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SKETCH = 256
#: Rows of a group that a task takes, outside its largest component and of all; pairs that it looks at at once.
LEFT, RIGHT, PAIRS = 1024, 4096, 1 << 18
#: Likely pairs of a group for each of its rows, beyond which it holds pairs back.
MANY = 4


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, BYTE_BASE))), dtype=np.uint64)


#: Bytes over which powers run, and the powers' inverses.
RUN = 1 << 14
POWERS = _powers(RUN)
INVERSES = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(RUN - 1, pow(int(BYTE_BASE), -1, 1 << 64), np.uint64))), dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, cut at ASCII white space, and each text's number of words.

    A word's sum of bytes times powers is the difference of two sums that run over RUN bytes, shifted to the word's start.
    """
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(parts).lower() + b" ", dtype=np.uint8)
    inside = ~((data == 32) | (data - np.uint8(9) <= 4))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    padded = np.zeros(-(-len(data) // RUN) * RUN, np.uint8)
    np.add(data, np.uint8(1), out=padded[: len(data)])  # UTF-8 has no byte 255
    sums = np.multiply(padded.reshape(-1, RUN), POWERS, dtype=np.uint64)
    sums = np.cumsum(sums, axis=1, out=sums).ravel()
    at = starts % RUN
    values = (sums[ends - 1] - np.where(at > 0, sums[starts - 1], np.uint64(0))) * INVERSES[at]
    for i in np.flatnonzero(starts // RUN != (ends - 1) // RUN):  # words that two runs share
        values[i] = ((data[starts[i] : ends[i]] + np.uint8(1)).astype(np.uint64) * _powers(int(ends[i] - starts[i]))).sum()
    return _mixed(values), counts


def shingle_sets(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and how many each has; see word_hashes for words.

    A text of fewer words has one shingle, all of them; one without words none.
    """
    words, counts = word_hashes(texts)
    runs = words.copy()
    for k in range(1, shingle):
        runs[: len(runs) - k] = runs[: len(runs) - k] * WORD_BASE + words[k:]
    runs = _mixed(runs)
    stop, first, keep = np.cumsum(counts), np.zeros(len(runs), bool), np.zeros(len(runs), bool)
    for end, n in zip(stop.tolist(), counts.tolist(), strict=True):
        start = end - n
        if n >= shingle:
            runs[start : end - shingle + 1].sort()
            keep[start : end - shingle + 1] = True
            first[start] = True
        elif n:
            value = 0
            for w in words[start:end].tolist():
                value = (value * int(WORD_BASE) + w) & 0xFFFFFFFFFFFFFFFF
            runs[start] = _mixed(np.array([value ^ n], dtype=np.uint64))[0]
            keep[start] = first[start] = True
    keep[1:] &= first[1:] | (runs[1:] != runs[:-1])
    before = np.concatenate(([0], np.cumsum(keep)))
    sizes = before[stop] - before[stop - counts]
    return runs[keep], sizes


class Bands:
    """Bands of set sizes, and the segments of each, for a similarity of percent hundredths or more."""

    def __init__(self, percent: int, fine: bool = False):
        self.percent, self.fine = percent, fine
        low, high = [1], [1]
        while high[-1] < 1 << 40:
            low.append(high[-1] + 1)
            high.append(max(low[-1], int(low[-1] * BAND)))
        self.low, self.high = np.array(low), np.array(high)
        #: sets x <= y <= high differ in (x + y) (100 - percent) / (100 + percent) tokens at most
        differ = 2 * self.high * (100 - percent) // (100 + percent)
        surplus = 2 * differ if fine else differ // 8
        #: commonest subsets that a set leaves out
        self.left_out = surplus if fine else 0 * differ
        self.segments = np.where(differ > 0, differ + 1 + surplus, 1)
        #: keys that a similar pair shares in a band at least: a key counts twice at most
        self.least = 0 * differ + 1 if fine else surplus // 2 + 1

    def entries(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, band, whether it is the set's own): where sets of these sizes are filed. Bands of equal sets only are left out."""
        own = np.searchsorted(self.high, sizes)
        sets, bands = [np.arange(len(sizes))], [own]
        reach, step = 100 * sizes // self.percent, 1
        while (further := np.flatnonzero(self.low[own + step] <= reach)).size:
            sets.append(further)
            bands.append(own[further] + step)
            step += 1
        at, band = np.concatenate(sets), np.concatenate(bands)
        keep = (self.segments[band] > 1) & (sizes[at] > 0)
        at, band = at[keep], band[keep]
        return at, band, band == own[at]


class Dealt:
    """The segments of the sets of a slice: keys of their subsets, and of these less one token."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, bands: Bands, entries: tuple | None = None):
        self.set, band, self.own = entries or bands.entries(sizes)
        self.band, self.least, self.left_out = band, bands.least[band], bands.left_out[band]
        width, n = bands.segments[band], sizes[self.set]
        base, start = np.cumsum(width) - width, (np.cumsum(sizes) - sizes)[self.set]
        self.entry = np.repeat(np.arange(len(width)), width)
        local = np.arange(int(width.sum())) - np.repeat(base, width)
        self.tag = _mixed((np.repeat(band + 128 * bands.fine, width).astype(np.uint64) << np.uint64(42)) + local.astype(np.uint64))
        token = tokens[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        #: of each token, in each band of its set: its segment's place
        self.place = np.repeat(base, n) + (_mixed(token) % np.repeat(width, n).astype(np.uint64)).astype(np.int64)
        self.value = _mixed(token + WORD_BASE)
        self.sums = np.zeros(len(local), np.uint64)
        np.add.at(self.sums, self.place, self.value)
        self.width, self.keys = width, _mixed(self.sums + self.tag)

    def less_one(self) -> np.ndarray:
        return _mixed(self.sums[self.place] - self.value + self.tag[self.place])

    def allocated(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segments that are searched, those searched for one token's difference too, keys less one token, entries that can't make up)."""
        less = self.less_one()
        dear = has(common, self.keys)
        many = np.bincount(self.entry, dear, len(self.width))
        enough = 2 * many <= self.width
        able = enough[self.entry]
        cost = np.bincount(self.place, 1.0 + COMMON * has(common, less), len(self.sums))
        cost = np.where(dear, 4095, np.minimum(cost, 4094)).astype(np.int64)
        # by entry, then cost, then place: 21, 12 and 31 bits, each value once, so that all workers agree
        order = np.sort(((self.entry << 43) + (cost << 31) + np.arange(len(cost))).view(np.uint64)) & np.uint64((1 << 31) - 1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(self.width) - self.width, self.width)
        return able & ~dear, able & (rank < many[self.entry]), less, ~enough


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of 2^bits bits in which the low bits of each key (a column of long) are set."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.groupBy(F.shiftright(at, 15).alias("piece")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for piece, held in rows:
        out[piece * 4096 : piece * 4096 + len(held)] = np.frombuffer(bytes(held), np.uint8)
    return out


def _sliced(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows (text, ...) in slices, with the shingle sets of their texts."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        begin, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text) // 6 + 1
            if size >= SLICE or k == len(texts) - 1:
                yield batch.slice(begin, k + 1 - begin), *shingle_sets(texts[begin : k + 1], shingle)
                begin, size = k + 1, 0


def _nodes_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """A 128-bit digest of each set, and its first 64 bits."""
    raw, stop = tokens.tobytes(), (8 * np.cumsum(sizes)).tolist()
    found = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *stop[:-1]], stop, strict=True)]
    return found, np.frombuffer(b"".join(found), dtype="<i8")[::2]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (text, id) as (id, size, node, digest, sketch): node is null for an empty set, see _nodes_of.

    sketch: for SKETCH buckets of the tokens whether each has an odd number of them, as bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, sizes in _sliced(batches, shingle):
            bucket = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + (_mixed(tokens ^ WORD_BASE) % np.uint64(SKETCH)).astype(np.int64)
            odd = np.bincount(bucket, minlength=SKETCH * len(sizes)).astype(np.uint8) & 1
            words = np.packbits(odd).view(np.int64).reshape(len(sizes), -1)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.ravel()))
            digest, node = _nodes_of(tokens, sizes)
            columns = [batch.column(1), pa.array(sizes), pa.array(node, mask=sizes == 0), pa.array(digest, pa.binary()), sketch]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "node", "digest", "sketch"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, size long, node long, digest binary, sketch array<long>")


def subset_keys(texts: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """(key) of every segment's subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, sizes in _sliced(batches, shingle):
            yield pa.RecordBatch.from_arrays([_long(Dealt(tokens, sizes, bands).keys)], names=["key"])

    return texts.mapInArrow(run, "key long")


def searched_keys(texts: DataFrame, shingle: int, bands: Bands, common: np.ndarray) -> DataFrame:
    """(key, less): of the segments searched for one token's difference, the subset and, less true, that less each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, sizes in _sliced(batches, shingle):
            dealt = Dealt(tokens, sizes, bands)
            _, double, less, _ = dealt.allocated(common)
            for keys, is_less in ((dealt.keys[double], False), (less[double[dealt.place]], True)):
                yield pa.RecordBatch.from_arrays([_long(keys), pa.array(np.full(len(keys), is_less))], names=["key", "less"])

    return texts.mapInArrow(run, "key long, less boolean")


def filed(texts: DataFrame, shingle: int, bands: Bands, common: np.ndarray, wanted: np.ndarray, neighbours: np.ndarray) -> DataFrame:
    """(key, node, size, own, probe, least, band, left_out): subsets that are in `wanted`, neighbours that are searched or
    looked for, and all fine subsets of sets that meet by these.

    own: filed in the set's own band; probe: the set searches there, and isn't only found there; least: how many keys a
    similar pair shares in that band at least; left_out: how many of its commonest fine subsets the set leaves out.
    """
    fine = Bands(bands.percent, fine=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, sizes in _sliced(batches, shingle):
            node, dealt = _nodes_of(tokens, sizes)[1], Dealt(tokens, sizes, bands)
            probe, double, less, others = dealt.allocated(common)
            exact = np.flatnonzero(has(wanted, dealt.keys))
            mine = double[dealt.place]
            near = np.flatnonzero(mine | has(neighbours, less))
            entry = np.concatenate((dealt.entry[exact], dealt.entry[dealt.place[near]]))
            yield rows(dealt, node, sizes, entry, np.concatenate((dealt.keys[exact], less[near])), np.concatenate((probe[exact], mine[near])))
            if others.any():
                finer = Dealt(tokens, sizes, fine, (dealt.set[others], dealt.band[others], dealt.own[others]))
                yield rows(finer, node, sizes, finer.entry, finer.keys, np.ones(len(finer.keys), bool))

    def rows(dealt: Dealt, node: np.ndarray, sizes: np.ndarray, entry: np.ndarray, keys: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        at = dealt.set[entry]
        columns = [_long(keys), _long(node[at]), _long(sizes[at]), pa.array(dealt.own[entry]), pa.array(probe)]
        columns += [_long(c[entry]) for c in (dealt.least, dealt.band, dealt.left_out)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "node", "size", "own", "probe", "least", "band", "left_out"])

    return texts.mapInArrow(run, "key long, node long, size long, own boolean, probe boolean, least long, band long, left_out long")


def sets_of(texts: DataFrame, shingle: int, nodes: np.ndarray) -> DataFrame:
    """(node, tokens) of the sets that may be among the nodes of a bitmap; tokens are sorted 64-bit words, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, sizes in _sliced(batches, shingle):
            node = _nodes_of(tokens, sizes)[1]
            stop = np.cumsum(sizes)
            keep = np.flatnonzero(has(nodes, node.view(np.uint64)))
            packed = [tokens[stop[i] - sizes[i] : stop[i]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([_long(node[keep]), pa.array(packed, pa.binary())], names=["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens binary")


def likely(spark: SparkSession, pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and sketches allow them to be as similar as asked.

    The sketches' Hamming distance is at most the number of tokens in which two sets differ.
    """
    end = lambda c: facts.select(F.col("node").alias(c), F.struct("size", "sketch").alias(f"{c}_is"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    x, y = F.col("a_is.size"), F.col("b_is.size")
    apart = sum(F.bit_count(F.col("a_is.sketch")[i].bitwiseXOR(F.col("b_is.sketch")[i])) for i in range(SKETCH // 64))
    near = both.filter((F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (apart * (100 + percent) <= (x + y) * (100 - percent)))
    return written(spark, near.select("a", "b"), "jaccard-likely")


def verified(spark: SparkSession, pairs: DataFrame, facts: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes, a written table, whose sets are as similar as asked, token by token.

    Only texts of these nodes are read. Sets are joined by salted keys, so a node with very many pairs is no single task.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    some = likely_in(texts, "id", likely_in(facts, "node", nodes).select("id"))
    held = sets_of(some, shingle, bitmap_of(nodes.withColumnRenamed("node", "key"))).groupBy("node").agg(F.first("tokens").alias("tokens"))
    held = written(spark, held, "jaccard-sets")
    one = join_salted(spark, pairs.select(F.col("a").alias("node"), "b"), held, "node")
    one = one.select(F.col("node").alias("a"), F.col("b").alias("node"), F.col("tokens").alias("left"))
    uses = written(spark, pairs.groupBy(F.col("b").alias("node")).count(), "jaccard-uses")
    met = join_salted(spark, one, held, "node", uses).select("a", F.col("node").alias("b"), "left", "tokens")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(close, "a long, b long")


def split_groups(spark: SparkSession, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of groups whose nodes aren't known to lie in one component, by roots (node, root): links to one node each.

    part: the component as far as known; main: whether it is the group's largest; n: the group's rows; few: those outside the largest.
    """
    part = F.coalesce("root", "node").alias("part")
    placed = written(spark, rows.join(roots, "node", "left").select("key", "node", "size", "own", "probe", "least", part), "jaccard-placed")
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key")
    mixed = sizes.agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("few"))
    mixed = written(spark, mixed.filter("few > 0"), "jaccard-mixed")
    split = join_counted(placed, mixed, ["key"], "n", "inner").withColumn("main", F.col("part") == F.col("main"))
    split = written(spark, split, "jaccard-split")
    removed(spark, placed, mixed)
    return split


def across(split: DataFrame, facts: DataFrame, percent: int, many: int | None = None) -> DataFrame:
    """(a, b, least, held): pairs of a group's rows in different components, an end outside its largest, that sizes and
    sketches allow to be similar. A pair comes once for each key that it shares, held is null.

    Of a group with more than `many` such pairs for each row only a forest over its components comes, the surest pairs
    first; held is the group's key then.

    Rows meet in tasks, which yield such pairs and no others. A large group is dealt over several: each takes about LEFT of
    the rows outside the largest component and RIGHT of all.
    """
    split = split.join(facts.select("node", "sketch"), "node")
    lefts, rights = F.ceil(F.col("few") / LEFT).cast("int"), F.ceil(F.col("n") / RIGHT).cast("int")
    some = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    facts = ["node", "size", "own", "probe", "least", "part", "main", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 64))]
    left = split.filter(~F.col("main")).select("key", some(lefts, 1).alias("i"), every(rights).alias("j"), F.lit(True).alias("left"), *facts)
    right = split.select("key", every(lefts).alias("i"), some(rights, 2).alias("j"), F.lit(False).alias("left"), *facts)
    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "left")

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, left, node, size, own, probe, least, part, main, *sketch = (c.to_numpy() for c in rows.columns)
        begins = np.flatnonzero(_begins(key, i, j))
        ends = np.append(begins[1:], len(key))
        of = np.repeat(np.arange(len(begins)), ends - begins)
        rows_right = np.bincount(of, ~left, len(begins)).astype(np.int64)
        at = np.flatnonzero(left & (rows_right[of] > 0))
        count = rows_right[of[at]]
        sofar, cut = np.cumsum(count), 0
        while cut < len(at):
            done = sofar[cut - 1] if cut else 0
            end = max(cut + 1, int(np.searchsorted(sofar, done + PAIRS, "right")))
            n = count[cut:end]
            a = np.repeat(at[cut:end], n)
            b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begins[of[a]]
            cut = end
            x, y = size[a], size[b]
            keep = (part[a] != part[b]) & (own[a] | own[b]) & (probe[a] | probe[b]) & (main[b] | (node[a] < node[b]))
            keep &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            a, b = a[keep], b[keep]
            apart = sum(np.bitwise_count((s[a] ^ s[b]).view(np.uint64)).astype(np.int64) for s in sketch)  # of signed ones it counts the absolute value's
            slack = (size[a] + size[b]) * (100 - percent) - apart * (100 + percent)
            keep = slack >= 0
            a, b, slack = a[keep], b[keep], slack[keep]
            held = np.zeros(len(a), bool)
            if many is not None:
                held = (np.bincount(of[a], minlength=len(begins)) > many * (ends - begins))[of[a]]
                joins = forest(of[a[held]], part[a[held]], part[b[held]], slack[held])
                keep = ~held
                keep[np.flatnonzero(held)[joins]] = True
                a, b, held = a[keep], b[keep], held[keep]
            columns = [_long(c) for c in (node[a], node[b], least[a])] + [pa.array(key[a], mask=~held)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "least", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            last = int(np.flatnonzero(_begins(*(held[c].to_numpy() for c in ("key", "i", "j"))))[-1]) if len(held) else 0
            yield from pairs_of(held[:last])
            held = held[last:]
        if held is not None:
            yield from pairs_of(held)

    return dealt.mapInArrow(run, "a long, b long, least long, held long")


def forest(group: np.ndarray, a: np.ndarray, b: np.ndarray, slack: np.ndarray) -> list[int]:
    """Places of the pairs (a, b) of components that join what isn't joined yet in their group, most slack first."""
    root, out = {}, []

    def find(x: tuple) -> tuple:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for k in np.argsort(-slack, kind="stable").tolist():
        x, y = find((group[k], a[k])), find((group[k], b[k]))
        if x != y:
            root[x] = y
            out.append(k)
    return out


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _linked(spark: SparkSession, texts: DataFrame, facts: DataFrame, shingle: int, percent: int, kept: Callable) -> DataFrame:
    """Components (node, root) of the links between different sets; nodes without a link are absent."""
    bands = Bands(percent)
    shared = written(spark, subset_keys(texts, shingle, bands).groupBy("key").count().filter("count > 1"), "jaccard-shared")
    common = bitmap_of(shared.filter(F.col("count") > COMMON))
    searched = searched_keys(texts, shingle, bands, common)
    searched = written(spark, searched.distinct(), "jaccard-searched")
    wanted, neighbours = bitmap_of(shared.select("key").union(searched.select("key"))), bitmap_of(searched.filter("not less"))
    removed(spark, shared, searched)
    rows = written(spark, filed(texts, shingle, bands, common, wanted, neighbours), "jaccard-filed")
    groups = rows.groupBy("key").agg(
        F.min_by("node", F.struct(~F.col("own"), "node")).alias("centre"), F.count("*").alias("n"), F.max("own").alias("own"), F.max("probe").alias("probe"),
        F.min("node").alias("low"), F.max("node").alias("high"),
    )
    groups = written(spark, groups.filter("own and probe and low < high").select("key", "n", "centre"), "jaccard-groups")
    met = written(spark, join_counted(rows, groups, ["key"], "n", "inner"), "jaccard-met")
    removed(spark, rows)
    # of fine subsets each set leaves out the commonest, in one order of all
    commonest = Window.partitionBy("node", "band").orderBy(F.desc("n"), "key")
    fine = met.filter("left_out > 0").withColumn("place", F.row_number().over(commonest)).filter("place > left_out").drop("place")
    met = written(spark, met.filter("left_out = 0").unionByName(fine).drop("band", "left_out"), "jaccard-met")
    # each set against the centre that most of its groups name
    stars = met.filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("count"), F.min("least").alias("least"))
    stars = stars.filter("count >= least").groupBy("node").agg(F.max_by("centre", F.struct("count", "centre")).alias("b"))
    stars = written(spark, stars.select(F.col("node").alias("a"), "b"), "jaccard-stars")
    stars = likely(spark, stars, facts, percent)
    near = written(spark, verified(spark, stars, facts, texts, shingle, percent), "jaccard-near")
    # what lies in different components of a group
    split = split_groups(spark, met, written(spark, components(spark, near), "jaccard-roots"))
    removed(spark, met, groups)
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = written(spark, across(split, facts, percent, MANY), "jaccard-across")
    pairs = found.groupBy(*ends).agg(F.count("*").alias("n"), F.min("least").alias("least"), F.count("held").alias("held"))
    pairs = written(spark, pairs.filter("n >= least or held > 0").select("a", "b"), "jaccard-pairs")
    near = near.unionByName(written(spark, verified(spark, pairs, facts, texts, shingle, percent), "jaccard-further"))
    # groups that held pairs back: all that still lie in different components
    held = written(spark, found.filter("held is not null").select(F.col("held").alias("key")).distinct(), "jaccard-held")
    if not held.isEmpty():
        roots = written(spark, components(spark, near), "jaccard-roots")
        split = split_groups(spark, split.join(held, "key"), roots)
        # with the keys that they shared in other groups
        again = across(split, facts, percent).select(*ends, "least", F.lit(1).alias("new"))
        again = again.unionByName(found.filter("held is null").select(*ends, "least", F.lit(0).alias("new")))
        pairs = again.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("new").alias("new"))
        pairs = written(spark, pairs.filter("n >= least and new = 1").select("a", "b"), "jaccard-pairs")
        further = written(spark, verified(spark, pairs, facts, texts, shingle, percent), "jaccard-further")
        near = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(further)
    return kept(components(spark, near), "jaccard-components")


def jaccard_groups(
    spark: SparkSession, docs: DataFrame, *, percent: int = 85, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, n_shingles, component_id) for each row of docs: component_id is the smallest id reachable by links.

    Two texts link when 100 x the size of the intersection of their sets of shingles is at least percent x that of the
    union. Words are lower-cased in A-Z and end at ASCII white space; a text of fewer words than a shingle has one
    shingle, all its words; one without words, or a null one, has none and links with nothing. Every text is read whole,
    however long; no link is left out. Tokens are 64-bit hashes of shingles.

    Repeated rows and repeated ids get a row each; a null id is never the smallest unless all of its group are null. An
    empty table gives an empty one; other columns of docs play no part.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent lies above 0 and not above 100: {percent}")
    texts = docs.select(text_of(docs, text_col).alias("text"), docs[id_col].alias("id"))
    rows = written(spark, described(texts, shingle), "jaccard-rows")
    nodes = rows.filter("size > 0").groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.min("digest").alias("low"), F.max("digest").alias("high"),
        F.first("size").alias("size"), F.first("sketch").alias("sketch"),
    )
    nodes = written(spark, nodes, "jaccard-nodes")
    if not nodes.filter("low <> high").isEmpty():
        raise RuntimeError("two sets share the first 64 bits of their digests")
    with temporary(spark) as kept:
        # one text of each node, or few, is enough
        once = likely_in(texts, "id", nodes.select(F.col("least").alias("id")))
        roots = _linked(spark, once, nodes.select("node", F.col("least").alias("id"), "size", "sketch"), shingle, percent, kept)
    placed = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(spark, placed, "jaccard-placed")
    firsts = written(spark, placed.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members")), "jaccard-firsts")
    named = written(spark, join_counted(placed, firsts, ["root"], "members").select("node", "copies", "first"), "jaccard-named")
    out = join_counted(rows.select("id", "size", "node"), named, ["node"], "copies")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("first"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), own.alias("component_id"))

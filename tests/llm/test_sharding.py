import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.llm import queries, sharding


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_and_inverse(n, seed):
    shuffle = sharding.RowShuffle(n, seed)
    places = shuffle.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert (shuffle.row(places) == np.arange(n)).all()


def test_row_at_is_computed(spark):
    shuffle = sharding.RowShuffle(1000, 11)
    shard, slot = shuffle.shard_slot(np.arange(1000), 24)
    for i in (0, 1, 500, 999):
        assert shuffle.row_at(int(shard[i]), int(slot[i]), 24) == i


def test_query(spark, make_docs, write_table, odd_texts):
    texts, ids = odd_texts * 4, [i // 2 if i % 5 else None for i in range(4 * len(odd_texts))]
    folder = write_table(make_docs(texts, ids))
    rows = queries.op3_feistel_shards(spark, folder).collect()
    assert len(rows) == len(texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    counts = [len(by_shard[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    expected = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    again = queries.op3_feistel_shards(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_many_equal_keys_are_dealt_and_names_clash(spark):
    df = spark.range(5000).select(F.lit(7).alias("k"), F.lit("a").alias("shard"), F.lit("b").alias("_part"))
    out = sharding.feistel_shards(spark, df, [F.col("k")], 24)
    assert {"shard", "shard_", "slot", "row_number", "_part"} == set(out.columns) - {"k"}
    assert sorted(r[0] for r in out.select("row_number").collect()) == list(range(5000))
    assert sharding.feistel_shards(spark, df.limit(0), [F.col("k")]).count() == 0


def brute_place(x, n, seed, rounds=sharding.ROUNDS):
    """The permutation of one row number in plain integers: Feistel rounds over the halves, walked until below n."""
    full = (1 << 64) - 1

    def mixed(v):
        v = (v + 0x9E3779B97F4A7C15) & full
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & full
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & full
        return v ^ (v >> 31)

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = x >> half, x & low
        for r in range(rounds):
            left, right = right, left ^ (mixed(right ^ mixed(seed * 1_000_003 + r)) & low)
        x = left << half | right
        if x < n:
            return x


def test_shard_and_slot_against_plain_integers(spark, make_docs, write_table):
    for n, seed in ((1, 3), (2, 3), (100, 11), (1025, 7)):
        shuffle = sharding.RowShuffle(n, seed)
        assert shuffle.place(np.arange(n)).tolist() == [brute_place(x, n, seed) for x in range(n)]
    ids = random.Random(1).sample(range(10_000), 157)
    rows = {r.doc_id: r for r in queries.op3_feistel_shards(spark, write_table(make_docs([f"t{i}" for i in ids], ids))).collect()}
    for number, i in enumerate(sorted(ids)):
        at = brute_place(number, 157, 11)
        assert (rows[i].shard, rows[i].slot, rows[i].law) == (at % 24, at // 24, "rows")
        assert (rows[i].size, rows[i].text_crc32) == (len(f"t{i}") + 8, zlib.crc32(f"t{i}".encode()))

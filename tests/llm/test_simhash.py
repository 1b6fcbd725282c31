import random
import re
import string

import numpy as np
import xxhash
from pyspark.sql import functions as F

from netquarry.llm import bktree_simhash as sim
from netquarry.llm import queries
from tests.llm.conftest import prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_print(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_query_against_brute_force(spark, make_docs, write_table, odd_texts):
    rng = random.Random(7)
    texts = list(odd_texts)
    for _ in range(40):
        words = prose(rng, rng.randint(5, 150)).split()
        for _ in range(rng.randint(1, 4)):
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    ids = rng.sample(range(10_000), len(texts))
    rows = {r.doc_id: r for r in queries.op10_simhash_groups(spark, write_table(make_docs(texts, ids))).collect()}
    prints = [brute_print(t) for t in texts]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in ids] == brute_components(ids, prints)


def test_majority_over_long_runs():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 254, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    got, at = sim.majority(hashes, counts), 0
    for n, word in zip(counts, got):
        part = hashes[at : at + n].tolist()
        at += n
        assert int(word) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in part) * 2 > n)


def test_forest_finds_all_pairs_within_radius():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**64, 20, dtype=np.uint64)
    words = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for s in seeds]))
    group = np.sort(rng.integers(0, 4, len(words)))
    tree = sim.Forest(words.reshape(-1, 1), group)
    got = {(int(a), int(b)) for x, y in tree.near(np.arange(len(words)), 4) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if group[i] == group[j] and bin(int(words[i] ^ words[j])).count("1") <= 4}
    assert got == want


def test_bands_lose_no_link():
    rng = random.Random(3)
    for n in (1000, 10**7, 10**10):
        bands = sim.exact_bands(n, 4)
        for _ in range(300):
            changed = set(rng.sample(range(64), 4))
            assert any(changed.isdisjoint(b) for b in bands)


def test_large_shards_are_split_without_losing_links(spark, monkeypatch):
    from netquarry.llm.shared import components

    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(1, 64, 2)})
    apart = sorted({base ^ (0xFFFFF << 40) ^ rng.getrandbits(20) for _ in range(200)})
    nodes = spark.createDataFrame([(p.to_bytes(8, "big"), p.to_bytes(8, "big")) for p in prints + apart], "fp binary, node binary")
    bands = sim.exact_bands(len(prints), 4)
    for most, again in ((50, 1000), (20, 2), (4096, 16)):  # in chunks; by other bits, then in chunks; whole
        monkeypatch.setattr(sim, "AGAIN", again)
        found = {r.node: r.root for r in components(spark, sim.links(spark, nodes, bands, 4, most=most)).collect()}
        whole = dict(zip(prints + apart, brute_components(prints + apart, prints + apart)))
        got = {int.from_bytes(n, "big"): int.from_bytes(r, "big") for n, r in found.items()}
        assert {p: got.get(p, p) for p in whole} == whole


def test_closest_links_are_a_minimum_spanning_forest(monkeypatch):
    rng = np.random.default_rng(5)
    for frontier in (500_000, 40):
        monkeypatch.setattr(sim, "FRONTIER", frontier)
        seeds = rng.integers(0, 2**64, 6, dtype=np.uint64)
        words = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for s in seeds]))
        group = np.sort(rng.integers(0, 2, len(words)))
        a, b = sim.Forest(words.reshape(-1, 1), group).closest(6)
        bits = lambda i, j: bin(int(words[i] ^ words[j])).count("1")  # noqa: B023, E731
        root = list(range(len(words)))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        total = 0
        for d, i, j in sorted((bits(i, j), i, j) for i in range(len(words)) for j in range(i) if group[i] == group[j]):
            if d <= 6 and find(i) != find(j):
                root[find(i)] = find(j)
                total += d
        assert sum(bits(i, j) for i, j in zip(a, b)) == total
        assert len(a) == len(words) - sum(find(i) == i for i in range(len(words)))


def test_each_row_has_its_nearest_allowed_ones(monkeypatch):
    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(0, 2**9, 150, dtype=np.uint64))
    colour = rng.integers(0, 3, len(words))
    for frontier in (500_000, 60):
        monkeypatch.setattr(sim, "FRONTIER", frontier)
        a, b = sim.Forest(words.reshape(-1, 1), np.zeros(len(words), int)).nearest(3, 2, lambda i, j: colour[i] != colour[j])
        got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        for i in range(len(words)):
            near = sorted(bin(int(words[i] ^ words[j])).count("1") for j in range(len(words)) if colour[i] != colour[j])
            mine = sorted(bin(int(words[x] ^ words[y])).count("1") for x, y in got if i in (x, y))
            assert mine[:2] == [d for d in near if d <= 3][:2]


def test_one_of_each_group_stays(spark, make_docs, odd_texts):
    rng = random.Random(9)
    base = [prose(rng, 300) for _ in range(12)]
    near = [t.replace(t.split()[150], "edited", 1) for t in base]
    texts = base + near + base
    docs = make_docs(texts).withColumn("fp", F.lit(1)).withColumn("_kept", F.lit(2))
    kept = sim.first_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))
    repeated = make_docs([base[0]] * 5 + [base[1]], ids=[3, 3, 3, None, 1, None])
    assert sorted(str(r.doc_id) for r in sim.first_of_each(spark, repeated).collect()) == ["1", "None"]
    odd = sim.first_of_each(spark, make_docs(odd_texts)).collect()
    assert {0, 3}.issubset({r.doc_id for r in odd}) and not {1, 2, 4, 6}.intersection({r.doc_id for r in odd})
    assert sim.first_of_each(spark, docs.limit(0)).count() == 0
    assert sim.simhash_groups(spark, docs.limit(0)).count() == 0


def jaccard(a, b):
    x, y = (set(sim.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_near_duplicates_against_brute_force(spark, make_docs):
    """No text goes without a chain of true links to one that stays; of the linked pairs at most a few stay both."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        words = prose(rng, rng.randint(6, 260)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = list(words) if rng.random() < 0.5 else texts[-1].split()
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    want = {i for i, r in enumerate(root) if i == r}
    got = {r.doc_id for r in sim.first_of_each(spark, make_docs(texts)).collect()}
    assert len(links) > 60 and want <= got
    assert sum(i in got and j in got for i, j in links) <= 0.02 * len(links)


def test_a_dense_family_whose_links_are_not_the_closest(spark, make_docs):
    """Texts with about three edits each of one template: most candidates are no links, and links are a few of many."""
    rng = random.Random(23)
    base = prose(rng, 200).split()
    texts = []
    for _ in range(500):
        words = list(base)
        for _ in range(rng.randint(2, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    sets = [set(sim.shingle_hashes(t, 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for _ in range(12):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    want = {i for i, r in enumerate(root) if i == r}
    got = {r.doc_id for r in sim.first_of_each(spark, make_docs(texts)).collect()}
    assert len(links) > 400 and len(want) < 200 and want <= got
    assert len(got - want) <= 0.02 * (len(texts) - len(want))


def test_candidates_beyond_the_closest_are_tested_too(spark, make_docs):
    """With one candidate of each set tested by joins, and bands and radius that miss nothing, all is as by brute force."""
    rng = random.Random(29)
    base = prose(rng, 160).split()
    texts = []
    for _ in range(240):
        words = list(base)
        for _ in range(rng.randint(2, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    sets = [set(sim.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(12):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    want = [i for i, r in enumerate(root) if i == r]
    got = sim.first_of_each(spark, make_docs(texts), each=1, width=8, missed=1e-6, deviations=6, most=60)
    assert 10 < len(want) < 150
    assert sorted(r.doc_id for r in got.collect()) == want


def test_a_large_group_of_near_copies(spark, make_docs):
    rng = random.Random(22)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    other = [prose(rng, 60) for _ in range(20)]
    got = sim.first_of_each(spark, make_docs(texts + other), most=40)  # its shards are cut in chunks
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(300, 320)]


def test_pairs_that_share_a_node_are_salted(spark):
    from netquarry.llm import shared

    left = spark.createDataFrame([(b"h" if i % 3 else bytes([i % 7]), i) for i in range(200)], "node binary, i int")
    right = spark.createDataFrame([(b"h", [1, 2]), *[(bytes([k]), [k]) for k in range(5)]], "node binary, hashes array<long>")
    got = shared.join_salted(spark, left, right, "node", each=10)
    want = {(r.node, r.i, tuple(r.hashes)) for r in left.join(right, "node").collect()}
    assert {(r.node, r.i, tuple(r.hashes)) for r in got.collect()} == want and got.count() == len(want)


def test_repeated_lines_count_once_among_near_duplicates(spark, make_docs):
    rng = random.Random(11)

    line, other = prose(rng, 16), prose(rng, 150)
    apart = [f"{prose(rng, 154)} " + " ".join([line] * times) for times in (20, 20, 40, 40)]
    same = [f"{other} " + " ".join([prose(random.Random(12), 16)] * times) for times in (2, 20)]
    assert all(jaccard(a, b) < 0.1 for i, a in enumerate(apart) for b in apart[:i]) and jaccard(*same) == 1
    assert sorted(r.doc_id for r in sim.first_of_each(spark, make_docs(apart + same)).collect()) == [0, 1, 2, 3, 4]

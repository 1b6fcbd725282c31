import random
import re

import numpy as np
import pytest

from netquarry.llm import jaccard_join, queries
from tests.llm.conftest import prose


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, ids, percent=85):
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted(((ids[i], len(s), least.get(find(i)) if s else ids[i]) for i, s in enumerate(sets)), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 1)] = [rng.choice(("anew", "other", prose(rng, 1)))] * rng.randint(0, 2)
    return " ".join(words)


def found(spark, docs, **options):
    rows = jaccard_join.jaccard_groups(spark, docs, **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("common", [2, 8])
def test_against_brute_force(spark, make_docs, odd_texts, monkeypatch, common):
    """Families near the limit, a dense family, short texts, and texts that one passage fills in part or for the most."""
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rng = random.Random(3 + common)
    texts = list(odd_texts)
    for size in (7, 12, 25, 40, 90, 200, 450):
        base = prose(rng, size).split()
        texts += [edited(rng, base, rng.randint(0, max(1, size // 30))) for _ in range(12)]
    dense = prose(rng, 60).split()
    texts += [edited(rng, dense, rng.randint(1, 4)) for _ in range(150)]
    spread = prose(rng, 150).split()  # near its template texts link, far from it they don't
    texts += [edited(rng, spread, rng.randint(0, 25)) for _ in range(200)]
    passage = prose(rng, 50)
    texts += [f"{prose(rng, n)} {passage} {prose(rng, n // 2)}" for n in (1, 2, 3, 6, 12, 30) for _ in range(25)]
    texts += [t.upper() for t in rng.sample(texts[len(odd_texts) :], 10)]
    ids = [i * 3 % 1009 for i in range(len(texts))]
    assert found(spark, make_docs(texts, ids)) == brute(texts, ids)


def test_family_far_from_its_template(spark, make_docs, monkeypatch):
    """Groups that hold pairs back have all links; what leaves the tasks grows with their rows, not with their pairs."""
    rng, met, real = random.Random(21), [], jaccard_join.across

    def counted(split, *args):
        out = real(split, *args)
        met.append((len(args), split.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "across", counted)
    monkeypatch.setattr(jaccard_join, "MANY", 1)
    monkeypatch.setattr(jaccard_join, "LEFT", 40)
    base = prose(rng, 110).split()
    texts = [edited(rng, base, rng.randint(2, 9)) for _ in range(300)]
    ids = list(range(len(texts)))
    assert found(spark, make_docs(texts, ids)) == brute(texts, ids)
    (first, rows, pairs), *again = met
    assert first == 3 and pairs <= 2 * rows and len(again) == 1


def test_words_across_runs():
    words = ["a" * 20_000, "b" * 16_384, "a" * 20_000, "é" * 9_000, "a" * 19_999, "b" * 16_384]
    values, counts = jaccard_join.word_hashes([" ".join(words), "x " * 8_192 + words[0]])
    assert counts.tolist() == [6, 8_193] and len(set(values[:6].tolist())) == 4
    assert values[0] == values[2] == values[-1] and values[1] == values[5]


def test_other_limits(spark, make_docs):
    rng = random.Random(9)
    texts = [edited(rng, base, rng.randint(0, 6)) for base in (prose(rng, 80).split() for _ in range(6)) for _ in range(12)]
    ids = list(range(len(texts)))
    for percent in (60, 100):
        assert found(spark, make_docs(texts, ids), percent=percent) == brute(texts, ids, percent)
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.jaccard_groups(spark, make_docs(["a"]), percent=0)


def test_odd_rows(spark, make_docs, odd_texts):
    """Null and repeated ids, repeated rows, clashing columns, an empty table."""
    texts = [*odd_texts, *odd_texts, None, ""]
    ids = [None if i % 4 == 1 else i // 2 for i in range(len(texts))]
    docs = make_docs(texts, ids).withColumnsRenamed({"lang": "component_id", "source": "node", "n_chars": "key"})
    assert found(spark, docs) == brute(texts, ids)
    assert found(spark, docs.limit(0)) == []
    assert found(spark, make_docs([None, "", " "])) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_bands_hold_every_similar_pair():
    """Sets of any two sizes that may be similar meet in the larger one's band, which has more segments than they differ in."""
    for percent in (60, 85, 99):
        bands = jaccard_join.Bands(percent)
        sizes = np.arange(1, 700)
        at, band, own = bands.entries(sizes)
        filed = set(zip(sizes[at].tolist(), band.tolist(), strict=True))
        home = dict(zip(sizes[at[own]].tolist(), band[own].tolist(), strict=True))
        for y in range(1, 700):
            for x in range(-(-y * percent // 100), y + 1):
                differ = (x + y) * (100 - percent) // (100 + percent)
                if differ:
                    assert (x, home[y]) in filed and bands.segments[home[y]] > differ


def test_hashes_follow_words(odd_texts):
    words, counts = jaccard_join.word_hashes([t or "" for t in odd_texts])
    spelled = [w for t in odd_texts for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    assert counts.sum() == len(words) == len(spelled)
    pairs = set(zip(spelled, words.tolist(), strict=True))
    assert len(pairs) == len(set(spelled)) == len(set(words.tolist()))


def test_whole_table(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the supplied tables are absent")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op12_jaccard_join(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute([d.text for d in docs], [d.doc_id for d in docs])

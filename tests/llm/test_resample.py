import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from netquarry.llm import queries, resample
from tests.llm.conftest import prose


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, ids, target, percent=25, least=20, buckets=10_000, longest=2, seed=7):
    def spread(text):
        w = words_of(text)
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    have, want = Counter(b for t in texts for b in spread(t)), Counter(b for t in target for b in spread(t))
    have_all, want_all = sum(have.values()) + buckets, sum(want.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * have_all / ((have[b] + 1) * want_all)))
    rows = []
    for text, i in zip(texts, ids, strict=True):
        found = spread(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, t in zip(rows, texts, strict=True) if len(words_of(t)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = k
    return sorted(map(tuple, rows), key=str)


def found(spark, docs, target, **options):
    return sorted(map(tuple, resample.resample(spark, docs, target, **options).collect()), key=str)


def test_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(6)
    texts = [*odd_texts, *odd_texts, *["hot " * 30] * 60, *[prose(rng, rng.randint(0, 60)) for _ in range(200)], "x-y_z.É1 " * 9]
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(texts))]
    target = [*texts[100:110], None, "", "HOT hot word"]
    docs = make_docs(texts, ids).withColumnsRenamed({"lang": "rank", "source": "k0", "n_chars": "id"})
    wanted = make_docs(target)
    assert found(spark, docs, wanted) == brute(texts, ids, target)
    for options in ({"percent": 0}, {"percent": 100}, {"percent": 61, "least": 0, "longest": 3, "buckets": 64, "seed": 1}):
        given = {("least_words" if k == "least" else k): v for k, v in options.items()}
        assert found(spark, docs, wanted, **given) == brute(texts, ids, target, **options)
    assert found(spark, docs, wanted.limit(0)) == brute(texts, ids, [])
    assert found(spark, docs.limit(0), wanted) == []


@pytest.mark.parametrize("spread", [3, 1000, 2**40, 2**62])
def test_kth_key(spark, spread):
    rng = random.Random(spread)
    keys = [(rng.randint(-spread, spread), rng.choice((0, 1)), rng.randint(-(2**63), 2**63 - 1) >> rng.choice((0, 30, 62))) for _ in range(300)]
    keys += [keys[0]] * 40
    rows = spark.createDataFrame(keys, "a long, b long, c long")
    for k in (1, 2, 150, 339, 340):
        assert resample.kth_key(rows, ["a", "b", "c"], k) == sorted(keys)[k - 1]
    assert resample.kth_key(rows, ["a"], 0) is None and resample.kth_key(rows, ["a"], 341) is None


def test_query_draws_a_quarter(spark, make_docs, write_table):
    rng = random.Random(8)
    folder = write_table(make_docs([prose(rng, 30) for _ in range(50)]))
    spark.createDataFrame([(1, prose(rng, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = queries.op13_target_resample(spark, folder).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 13)) and len(rows) == 50

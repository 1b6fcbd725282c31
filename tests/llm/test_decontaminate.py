import random

from pyspark.sql import functions as F

from netquarry.llm import decontaminate as dec
from tests.llm.conftest import prose


def distance(item, text):
    """Edit distance to the nearest substring, by dynamic programming."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_finds_what_brute_force_finds():
    rng = random.Random(1)
    items = [(k, prose(rng, rng.randint(3, 25))) for k in range(12)]
    matcher = dec.Matcher(items)
    for trial in range(80):
        k = rng.randrange(12)
        text = prose(rng, 10) + " " + edited(rng, items[k][1], rng.randint(0, len(items[k][1]) // 8)) + " " + prose(rng, 10)
        plain = dec.plain(text)
        want = {}
        for number, item in items:
            d = distance(dec.plain(item), plain)
            if d <= int(dec.RATE * len(dec.plain(item))):
                want[number] = d
        found = matcher.find(text)
        assert {n: d for n, d, _, _ in found} == want
        for n, d, a, b in found:
            assert distance(dec.plain(items[n][1]), plain[a:b]) == d


def test_tables_with_odd_rows(spark, make_docs, odd_texts):
    rng = random.Random(2)
    items = [(1, prose(rng, 20)), (2, None), (3, ""), (1, prose(rng, 15)), (4, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = odd_texts + ["x " + items[0][1].upper().replace(" ", "\n ") + " y", items[3][1], items[3][1]]
    docs = make_docs(texts).withColumn("distance", F.lit("clash"))
    rows = dec.matches(spark, docs, bench).collect()
    n = len(odd_texts)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == [(n, 1, 0), (n + 1, 1, 0), (n + 2, 1, 0)]
    kept = dec.without_leaks(spark, docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(n))
    assert dec.matches(spark, docs, bench, block_chars=1).count() == 3  # a pass per item finds the same
    assert sorted(r.doc_id for r in dec.without_leaks(spark, docs, bench, block_chars=1).collect()) == list(range(n))
    assert dec.matches(spark, docs.limit(0), bench).count() == 0
    assert dec.matches(spark, docs, bench.limit(0)).count() == 0 and dec.without_leaks(spark, docs, bench.limit(0)).count() == len(texts)

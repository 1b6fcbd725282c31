import random

from pyspark.sql import functions as F

from netquarry.llm import shared


def test_join_counted_is_a_join(spark, monkeypatch):
    rng = random.Random(1)
    keys = [rng.choice([7] * 10 + list(range(40))) for _ in range(500)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first")).filter("k <> 3")
    want = sorted((i, k, *((None, None) if k == 3 else (keys.count(k), keys.index(k)))) for i, k in enumerate(keys))
    for hot in (1, 5, 4096):
        monkeypatch.setattr(shared, "HOT_KEYS", hot)
        assert sorted((r.i, r.k, r.n, r.first) for r in shared.join_counted(left, right, ["k"], "n").collect()) == want
        inner = shared.join_counted(left, right, ["k"], "n", "inner").collect()
        assert sorted((r.i, r.k, r.n, r.first) for r in inner) == [w for w in want if w[1] != 3]
    assert shared.join_counted(left.limit(0), right.limit(0), ["k"], "n").count() == 0


def test_likely_in_keeps_all_that_are_in(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), "id")
    keys = rows.filter("id % 10 = 3").select("k")
    found = {r.id for r in shared.likely_in(rows, "k", keys).collect()}
    wanted = set(range(3, 20_000, 10))
    assert wanted <= found and len(found - wanted) < 50
    assert shared.likely_in(rows, "k", keys.limit(0)).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    hub = [(5000, 5000 + i) for i in range(1, 300)] + [(5000 + i, 6000 + i) for i in range(1, 50)]
    loose = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    links = chain + hub + loose
    root = {n: n for pair in links for n in pair}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    alone = {n for n in root if not any(n in pair for pair in links if pair[0] != pair[1])}
    rows = shared.components(spark, spark.createDataFrame(links, "a int, b int")).collect()
    assert {r.node: r.root for r in rows} == {n: r for n, r in root.items() if n not in alone} and len(rows) == len(root) - len(alone)
    assert shared.components(spark, spark.createDataFrame([], "a int, b int")).count() == 0

import random
import re
from itertools import permutations

import pytest

from netquarry.llm import filter_audit, queries


def flags(texts, ids):
    out = []
    for text, i in zip(texts, ids, strict=True):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for t, j in zip(texts, ids, strict=True))
        capitals = sum("A" <= c <= "Z" for c in text)
        out.append([len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), bool(re.search("[#$%&*|]", text)), earlier])
    return out


def brute(parts, fails, good, toxic):
    """Every order is applied for itself."""
    out = {}
    for part in set(parts):
        mine = [i for i, p in enumerate(parts) if p == part]
        total = dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if fails[i][f]}
                failing = {i for i in mine if fails[i][f]}
                left -= gone
                total[f] += len(gone)
                alone = sum(sum(fails[i]) == 1 for i in failing)
                name = "".join("ABCDE"[k] for k in order)
                out[part, name, step] = [len(left), len(gone), len(failing - gone), alone, sum(good[i] for i in gone), sum(toxic[i] for i in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total["ABCDE".index(key[1][key[2] - 1])]
    return sorted((*k, *v) for k, v in out.items())


def found(spark, docs, labels):
    rows = filter_audit.flagged(spark, docs, labels)
    return sorted(map(tuple, filter_audit.audit(rows, "part", list("ABCDE"), ["good", "toxic"]).collect()))


def test_against_applying_every_order(spark, make_docs, odd_texts, monkeypatch):
    rng = random.Random(4)
    texts = [*odd_texts, *odd_texts, *["A # b"] * 40, *[" ".join(rng.choice("aAb#c") for _ in range(rng.randint(0, 90))) for _ in range(150)]]
    ids = [None if i % 11 == 3 else i // 2 for i in range(len(texts))]
    parts = [rng.choice(["x", "y", "y", None, ""]) if i > 20 else "z" for i in range(len(texts))]
    rated = [(i, q, t) for i in range(0, 90, 2) for q, t in ((rng.randint(0, 1), rng.randint(0, 1)), (0, rng.choice((None, 1))))] + [(None, 1, 1)]
    labels = spark.createDataFrame(rated, "doc_id long, quality int, toxic int")
    good = [i is not None and any(r[0] == i and r[1] == 1 for r in rated) for i in ids]
    toxic = [i is not None and any(r[0] == i and r[2] == 1 for r in rated) for i in ids]
    docs = make_docs(texts, ids, [p if p is not None else None for p in parts]).withColumn("part", docs_clash()).withColumn("digest", docs_clash())
    shown = make_docs(texts, ids).limit(0)
    want = brute([p or "" for p in parts], flags(texts, ids), good, toxic)
    assert found(spark, docs, labels) == want and len(want) == 600 * len({p or "" for p in parts})
    monkeypatch.setattr(filter_audit, "BLOCK", 7)
    assert found(spark, docs, labels) == want
    assert found(spark, shown, labels) == []
    assert len(found(spark, docs, labels.limit(0))) == len(want)


def docs_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_fewer_filters_and_marks(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("p", False, False)], "part string, long boolean, odd boolean")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(rows, "part", ["long", "odd"]).collect()}
    assert found == {("longodd", 1): (1, 2, 0, 1, 3), ("longodd", 2): (1, 0, 1, 0, 1), ("oddlong", 1): (2, 1, 0, 0, 1), ("oddlong", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(rows, "part", [f"f{i}" for i in range(8)])


def test_query_has_every_part_and_order(spark, make_docs, odd_texts, write_table):
    folder = write_table(make_docs(odd_texts))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert queries.op11_filter_audit(spark, folder).count() == 600 * 3

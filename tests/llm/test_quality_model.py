import random

import numpy as np
from pyspark.sql import functions as F

from netquarry.llm import quality_model as qm
from netquarry.llm import queries
from tests.llm.conftest import prose


def junk(rng, n):
    return " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in prose(rng, n).split())


def test_thresholds_are_ordered_and_gradient_descends():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    doc, slot = np.arange(400), grade * 7 + rng.integers(0, 2, 400)
    model = qm.fit_ordinal(doc, slot, np.full(400, 8.0), grade, 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(8.0 * model.weights[np.array([0, 7, 14, 21])])
    expected = tails.sum(axis=1)
    assert (np.diff(expected) > 0.5).all() and (np.diff(tails, axis=1) <= 0).all()
    flat = qm.fit_ordinal(doc[:0], slot[:0], np.zeros(0), grade[:0], 3)
    assert flat.thresholds.tolist() == [0, 1]


def test_held_out_accuracy_and_clean_documents_stay(spark, make_docs, write_table, odd_texts):
    rng = random.Random(2)
    poor = [i % 5 == 0 for i in range(500)]
    texts = [junk(rng, rng.randint(10, 90)) if p else prose(rng, rng.randint(10, 90)) for p in poor]
    folder = write_table(make_docs(texts + odd_texts))
    rated = [(i, int(not poor[i]), int(i % 7 == 0)) for i in range(300)] + [(1, None, 1), (None, 0, 0), (2, 1, None)]
    spark.createDataFrame(rated, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = {r.doc_id: r for r in queries.op7_ordinal_quality(spark, folder).collect()}
    assert len(rows) == len(texts) + len(odd_texts)
    held = range(300, 500)
    assert np.mean([rows[i].kept == (not poor[i]) for i in held]) > 0.97
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows.values())


def test_without_labels_or_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts).withColumn("graded", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = qm.train(spark, docs, none, 3)
    assert qm.graded(docs, model, name="graded_").count() == len(odd_texts)
    assert qm.graded(docs.limit(0), model, name="graded_").count() == 0
    twice = spark.createDataFrame([(3, 1), (3, 1), (None, 2), (5, None)], "doc_id long, grade int")
    assert qm.train(spark, docs, twice, 3).thresholds.shape == (2,)


def test_slopes_against_numeric_ones_and_a_slow_likelihood(monkeypatch):
    monkeypatch.setattr(qm, "DIMS", 6)
    rng = np.random.default_rng(3)
    n, grades, decay = 40, 4, 0.01
    doc, slot, value = np.repeat(np.arange(n), 2), rng.integers(0, 6, 2 * n), rng.uniform(0.5, 2, 2 * n)
    grade, w, cuts = rng.integers(0, grades, n), rng.normal(size=6), rng.normal(size=grades - 1)

    def slow(w, cuts):
        theta = [-np.inf, cuts[0], *(cuts[0] + sum(np.exp(c) for c in cuts[1 : j + 1]) for j in range(1, grades - 1)), np.inf]
        total = 0.0
        for i in range(n):
            s = sum(value[k] * w[slot[k]] for k in range(2 * n) if doc[k] == i)
            below = [1 / (1 + np.exp(s - t)) for t in theta]
            total -= np.log(below[grade[i] + 1] - below[grade[i]])
        return total / n + decay / 2 * sum(w * w)

    loss, by_w, by_cuts = qm.loss_and_slopes(w, cuts, doc, slot, value, grade, decay)
    assert abs(loss - slow(w, cuts)) < 1e-9
    for x, slopes, at in ((w, by_w, lambda y: slow(y, cuts)), (cuts, by_cuts, lambda y: slow(w, y))):
        for k in range(len(x)):
            step = np.eye(len(x))[k] * 1e-5
            assert abs((at(x + step) - at(x - step)) / 2e-5 - slopes[k]) < 1e-6


def test_grades_against_a_slow_version_and_repeated_ids(spark, make_docs, odd_texts):
    rng = random.Random(6)
    texts = [junk(rng, 20) if i % 3 == 0 else prose(rng, 30) for i in range(60)] + odd_texts
    docs = make_docs(texts).withColumn("graded", F.lit(0))
    rated = spark.createDataFrame([(i, 0 if i % 3 == 0 else 2) for i in range(60)] + [(1, 9), (2, None)], "doc_id long, grade int")
    model = qm.train(spark, docs, rated, 3)
    got = {r.doc_id: r.graded_ for r in qm.graded(docs, model).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        parts = [model.weights[s] for w in words for s in qm.slots(w)] + [model.weights[qm.REPEAT] for a, b in zip(words, words[1:]) if a == b]
        score = qm.SCALE * sum(parts) / len(words) if words else 0.0
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert abs(got[i].tail - tails[0]) < 1e-9 and abs(got[i].expected - sum(tails)) < 1e-9
    crowd = make_docs(["poor ### text"] * 500 + texts[:60], ids=[0] * 500 + list(range(60)))
    assert qm.train(spark, crowd, rated, 3, sample=30).thresholds.shape == (2,)

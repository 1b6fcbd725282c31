import math
import random
import zlib

import numpy as np

import pytest
from pyspark.sql import functions as F

from netquarry.llm import queries, toxicity
from tests.llm.conftest import prose

INSULTS = ["blorgface", "snotgoblin", "numpty", "ratweasel"]


def rude(rng, n):
    words = prose(rng, n).split()
    for _ in range(max(2, n // 25)):
        words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
    return " ".join(words)


def auc(scores, labels):
    good = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum(good) / len(good)


def test_held_out_accuracy(spark, make_docs, write_table, odd_texts):
    rng = random.Random(1)
    toxic = [i % 6 == 0 for i in range(900)]
    texts = [rude(rng, rng.randint(30, 120)) if t else prose(rng, rng.randint(30, 120)) for t in toxic]
    folder = write_table(make_docs(texts + odd_texts))
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = {r.doc_id: r for r in queries.op5_toxic_compression(spark, folder).collect()}
    assert len(rows) == len(texts) + len(odd_texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in range(900) if rows[i].held_out]
    assert auc([rows[i].score for i in held], [toxic[i] for i in held]) > 0.9


def test_few_or_no_labels_and_odd_columns(spark, make_docs, odd_texts):
    assert toxicity.fit([], ["a b c"]).probability(toxicity.fit([], ["a"]).weights.reshape(1, -1)).shape == (1,)
    docs = make_docs(odd_texts, ids=[None] + list(range(1, len(odd_texts)))).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, none)
    found = toxicity.scored(docs, model, name="toxic_score")
    assert found.filter("toxic_score between 0 and 0.1").count() == len(odd_texts)
    assert toxicity.scored(docs.limit(0), model, name="x").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(spark, docs, nulls) is not None
    assert [r[0] for r in spark.range(1).select(toxicity.held_out(F.lit(None).cast("long"))).collect()] == [True]


def test_segments_and_windows():
    assert list(toxicity._segments("a numpty numpty b numpty", {b"numpty"})) == [b" numpty numpty ", b" numpty "]
    assert len(toxicity.windows("w " * 50)) == pytest.approx(-(-50 // toxicity.WINDOW_WORDS))
    assert toxicity.windows("") == []


def test_wording_of_few_toxic_texts_enters_the_dictionary():
    rng = random.Random(4)
    common = [rude(rng, 30) for _ in range(990)]
    rare = [f"{prose(rng, 15)} zwickwanst {prose(rng, 15)}" for _ in range(10)]  # 1 % of the toxic texts
    model = toxicity.dictionaries(common + rare, [prose(rng, 30) for _ in range(2000)])
    assert b"zwickwanst" in model.toxic and b"numpty" in model.toxic
    assert model.measurer()("zwickwanst zwickwanst a b c d")[1] > 0


def test_scores_against_a_slow_version(spark, make_docs, odd_texts):
    """Every window compressed by fresh compressors, the features and the curve written out."""
    import zstandard

    rng = random.Random(8)
    toxic, plain = [rude(rng, 40) for _ in range(60)], [prose(rng, 40) for _ in range(200)]
    model = toxicity.fit(toxic, plain)

    def length(content, data):
        settings = zstandard.ZstdCompressionParameters.from_level(
            6, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=kept, compression_params=settings).compress(data))

    texts = odd_texts + toxic[:20] + plain[:20]
    got = {r.doc_id: r.score_ for r in toxicity.scored(make_docs(texts).withColumn("score", F.lit(1)), model).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        gains = []
        for k in range(0, len(words), 20):
            data = b" " + b" ".join(words[k : k + 20]) + b" "
            gains.append(length(model.ordinary, data) - length(model.toxic + model.ordinary, data))
        gains.sort()
        x = [1.0, 0, 0, 0, 0] if not gains else [1.0, gains[-1], sum(gains) / len(gains), sum(gains[-3:]) / len(gains[-3:]), sum(g >= 4 for g in gains) / len(gains)]
        score = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights))))))
        assert abs(got[i] - score) < 1e-9


def test_balance_follows_the_rated_rows():
    rng = random.Random(9)
    toxic, plain = [rude(rng, 15) for _ in range(40)], [prose(rng, 15) for _ in range(120)]
    base = lambda odds: toxicity.fit(toxic, plain, odds).probability(np.array([[1.0, 0, 0, 0, 0]]))[0]
    assert base(1.0) > base(8.0) > base(100.0) and base(None) == base(3.0)

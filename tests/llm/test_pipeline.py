import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from netquarry.llm import mixing
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import distance


def test_stages_and_run(spark, make_docs, write_table, odd_texts):
    rng = random.Random(1)
    clean = [prose(rng, rng.randint(80, 160)) for _ in range(80)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:20]]
    near = [t.replace(t.split()[40], "edited", 1) for t in clean[:10]]
    items = [(k, prose(rng, 20)) for k in range(4)]
    leaks = [prose(rng, 60) + " " + t + " " + prose(rng, 60) for _, t in items]
    texts = clean + junk + near + leaks + odd_texts
    folder = write_table(make_docs(texts))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rated = [(i, 1, 0) for i in range(60)] + [(80 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(rated, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    good, apart, unleaked, mixed = seen
    assert set(range(80)) <= set(good) and not set(range(80, 100)) & set(good)
    assert set(range(80)) <= set(apart) and not set(range(100, 110)) & set(apart)
    plain = [" ".join(text.lower().split()) for _, text in items]
    holds = lambda text: any(distance(p, " ".join((text or "").lower().split())) <= len(p) // 10 for p in plain)
    long = [i for i in apart if len(texts[i] or "") > 20_000]  # too long for dynamic programming; it is random prose
    assert unleaked == [i for i in apart if i in long or not holds(texts[i])]
    assert set(range(110, 114)) & set(apart) and not set(range(110, 114)) & set(unleaked)
    assert max(mixed.count(i) for i in set(mixed)) <= 3 and set(mixed) <= set(unleaked)
    words = sum(len((texts[i] or "").split()) for i in unleaked)
    assert abs(sum(len((texts[i] or "").split()) for i in mixed) - words) <= 0.1 * words + 15_000  # one text is most of a source, and documents stay whole

    final = cp.run(spark, folder).collect()
    assert sorted(r.doc_id for r in final) == mixed
    counts = [sum(r.shard == s for r in final) for s in range(cp.SHARDS)]
    assert max(counts) - min(counts) <= 1
    assert mixing.cyclic_weights((5, 2, 1))(["a", "b", "c", "d"]) == [5, 2, 1, 5]


def test_empty_documents(spark, make_docs, write_table):
    folder = write_table(make_docs(["a"]).limit(0))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert cp.run(spark, folder).count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark, make_docs, write_table, odd_texts):
    """Stage by stage, with columns called like those that the operators make."""
    rng = random.Random(3)
    texts = odd_texts + [prose(rng, 60) for _ in range(20)] + [prose(rng, 30)] * 2
    ids = [None if i % 4 == 0 else i // 2 for i in range(len(texts))]
    names = ("graded", "_mark", "_kept", "_n", "size", "copies", "part", "taken", "mix_sources", "row_number", "shard", "slot", "_pass", "node", "root", "_facts")
    docs = make_docs(texts + texts[:3], ids + ids[:3], sources=[None if i % 5 == 0 else "s" for i in range(len(texts) + 3)])
    docs = docs.withColumns({n: F.lit(f"clash {n}") for n in names if n != "_facts"})
    folder = write_table(docs)
    spark.createDataFrame([(1, texts[20]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = {}
    for name, stage in cp.STAGES:
        out = stage(spark, rows, folder)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "shards" or out.columns == docs.columns), name
        assert out.filter("size <> 'clash size' or shard <> 'clash shard'").isEmpty()
        sizes[name] = sorted(str((r.doc_id, r.text)) for r in out.select("doc_id", "text").collect())
    assert sizes["shards"] == sorted(str((r.doc_id, r.text)) for r in rows.select("doc_id", "text").collect())
    assert len(sizes["near_duplicates"]) < len(texts) and not any(texts[20] in t for t in sizes["benchmark_leaks"])
    assert {t for t in sizes["source_mix"]} <= set(sizes["shards"])


def test_run_leaves_only_its_result(spark, make_docs, write_table, tmp_path):
    rng = random.Random(4)
    folder = write_table(make_docs([prose(rng, 40) for _ in range(30)]))
    spark.createDataFrame([(1, prose(rng, 10))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    assert cp.run(spark, folder).count() > 0
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(shared)) - before] == ["pipeline-shards"]


def test_workers_get_small_batches(spark, make_docs, write_table):
    """However large the session's batches, a stage gives its workers few rows at once: texts may be long."""
    size, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", make_docs([prose(random.Random(2), 30)] * 3000)
    folder = write_table(docs)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = spark.conf.get(size)
    try:
        for name, stage in (cp.STAGES[0], cp.STAGES[-1]):
            spark.conf.set(size, 10_000)
            rows = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id")
            most = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"doc_id": [b.num_rows]}) for b in batches), "doc_id long")
            assert max(r.doc_id for r in most.collect()) <= cp.BATCH, name
            spark.conf.set(size, 100)
            stage(spark, docs, folder)
            assert int(spark.conf.get(size)) == 100
    finally:
        spark.conf.set(size, before)

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from netquarry.llm import stream_dedup as sd
from tests.llm.conftest import prose


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))
    out = []
    for content, members in groups.items():
        best = max(members, key=lambda m: (len(m[1] or ""), m[0] is not None, -(m[0] or 0)))
        for i, _ in members:
            out.append((str(i), str(best[0]), len(members), hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force_in_many_batches(spark, make_docs, write_table, odd_texts):
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 30)) for _ in range(30)]
    texts = odd_texts + [rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n", ""])) for _ in range(200)]
    ids = rng.sample(range(1000), len(texts))
    ids[3] = None
    ids[20] = ids[21]
    folder = write_table(make_docs(texts, ids).withColumn("digest", F.lit("clash")).withColumn("stays", F.lit(1)).repartition(7))
    rows = sd.stream_dedup(spark, f"{folder}/documents.parquet", batch_bytes=20_000).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest) for r in rows) == brute(list(zip(ids, texts)))
    assert sum(r.kept for r in rows) == len({r.digest for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_digests_that_collide_are_resolved_by_content(spark, make_docs, write_table):
    texts = ["a b", "ab", "c", "c ", "dd", "ee"] * 3
    folder = write_table(make_docs(texts))
    weak = lambda content: F.substring(F.sha2(content, 256), 1, 0)  # noqa: E731  every text has the same digest
    rows = sd.stream_dedup(spark, f"{folder}/documents.parquet", digest=weak).collect()
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in rows)
    want = sorted((int(i), int(k), n) for i, k, n, _ in brute(list(enumerate(texts))))
    assert got == want and sum(r.kept for r in rows) == 4


def test_empty_table_and_single_file(spark, make_docs, write_table, tmp_path):
    folder = write_table(make_docs(["a"]).limit(0))
    assert sd.stream_dedup(spark, f"{folder}/documents.parquet").count() == 0
    import pandas as pd

    pd.DataFrame({"doc_id": [1, 2], "text": ["x", "x "]}).to_parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.keep_id) for r in sd.stream_dedup(spark, f"{tmp_path}/documents.parquet").collect()} == {(1, 2), (2, 2)}


def test_columns_with_the_names_of_metadata_play_no_part(spark, make_docs, write_table):
    texts = ["a b", "ab", "c", None, ""] * 2
    docs = make_docs(texts).withColumns({"_metadata": F.lit("clash"), "place": F.lit(1), "content": F.lit(2), "key": F.lit(3)})
    folder = write_table(docs)
    rows = sd.stream_dedup(spark, f"{folder}/documents.parquet").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest) for r in rows) == brute(list(enumerate(texts)))


def test_some_digests_collide(spark, make_docs, write_table):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 2)) for _ in range(300)]
    folder = write_table(make_docs(texts))
    weak = lambda content: F.substring(F.sha2(content, 256), 1, 2)  # noqa: E731  256 digests for more contents
    rows = sd.stream_dedup(spark, f"{folder}/documents.parquet", digest=weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == sorted((int(i), int(k), n) for i, k, n, _ in brute(list(enumerate(texts))))
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "unset") != "false"

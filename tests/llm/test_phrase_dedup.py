import hashlib
import random
import re

from pyspark.sql import functions as F

from netquarry.llm import phrase_dedup as pd_
from netquarry.llm import queries
from tests.llm.conftest import prose


def brute(rows, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    key = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, words):
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        drop = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < key(i):
                drop[j : j + window] = [True] * window
        kept = " ".join(x for x, gone in zip(w, drop) if not gone)
        out.append((str(i), len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(rng, n, passages):
    texts = []
    for _ in range(n):
        parts = [prose(rng, rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 10)
            parts += [" ".join(p[a : len(p) - rng.randint(0, 10)]), prose(rng, rng.randint(0, 20))]
        texts.append(rng.choice([" ", "\n", "  "]).join(x for x in parts if x))
    return texts


def test_query_against_brute_force(spark, make_docs, write_table, odd_texts):
    rng = random.Random(1)
    passages = [prose(rng, rng.randint(45, 130)) for _ in range(6)] + [" ".join(["a"] * 70), " ".join(["a b"] * 40)]
    texts = odd_texts + corpus(rng, 120, passages)
    texts += texts[30:50]
    ids = rng.sample(range(10_000), len(texts))
    rows = queries.op9_repeated_phrases(spark, write_table(make_docs(texts, ids))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute(list(zip(ids, texts)))


def test_small_windows_null_and_repeated_ids(spark, make_docs):
    rng = random.Random(2)
    passages = [prose(rng, rng.randint(8, 20)) for _ in range(5)]
    texts = [t for t in corpus(rng, 60, passages)]
    texts[5] = texts[6]
    ids = list(range(60))
    ids[5] = ids[6] = 40
    ids[7] = ids[9] = None
    docs = make_docs(texts, ids).withColumn("mark", F.lit(1)).withColumn("block", F.lit(2))
    rows = pd_.remove_repeats(spark, docs, window=10, gram=3, block_words=300).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute(list(zip(ids, texts)), 10)


def test_nothing_repeats_and_empty(spark, make_docs, odd_texts):
    rng = random.Random(3)
    docs = make_docs([prose(rng, 60) for _ in range(5)])
    assert {r.n_removed for r in pd_.remove_repeats(spark, docs).collect()} == {0}
    assert pd_.remove_repeats(spark, docs.limit(0)).count() == 0


def test_a_passage_that_most_documents_share(spark, make_docs):
    rng = random.Random(4)
    shared = prose(rng, 80)
    texts = [f"{prose(rng, 30)} {shared} {prose(rng, 10)}" for _ in range(200)]
    texts.append(" ".join([shared] * 30))  # a text of one passage over and over
    rows = pd_.remove_repeats(spark, make_docs(texts), block_words=2000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute(list(enumerate(texts)))


def test_a_third_of_all_rows_are_the_same(spark, make_docs, monkeypatch):
    """Rows of one id and text, null ids too, meet the texts once each: their windows are located once."""
    rng = random.Random(6)
    shared = prose(rng, 70)
    texts = [f"{prose(rng, 20)} {shared} {prose(rng, 5)}" for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, f"start {shared} end")] * 60 + [(7, texts[7])] * 30
    met = []
    kept = pd_.written
    monkeypatch.setattr(pd_, "written", lambda spark, df, name: met.append(kept(spark, df, name)) or met[-1] if name == "phrase-texts" else kept(spark, df, name))
    found = pd_.remove_repeats(spark, make_docs([t for _, t in rows], [i for i, _ in rows]), block_words=2000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute(rows)
    assert met[0].count() == 41

"""The registered queries of this subpackage over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import (
    bktree_simhash,
    decontaminate,
    filter_audit,
    jaccard_join,
    license_scan,
    mixing,
    phrase_dedup,
    quality_model,
    resample,
    secret_scan,
    sharding,
    stream_dedup,
    toxicity,
)
from netquarry.llm.shared import text_of, utf8_crc32

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 24
KEEP_TAIL = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixing.mix(spark, docs, F.array("source"), mixing.cyclic_weights((5, 2, 1))).documents
    own = F.col("mix_sources")[0]
    return found.select("doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken")


def op2_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = text_of(docs)
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), utf8_crc32(text).alias("text_crc32")
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = sharding.feistel_shards(spark, slim, order, SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(spark, docs, owner=docs["source"], repository=docs["lang"])


def op5_toxic_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = _table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    found = toxicity.scored(docs, toxicity.train(spark, docs, rated))
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.stream_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    grades = quality_model.quality_grades(_table(spark, sf_dir, "labels"))
    found = quality_model.graded(docs, quality_model.train(spark, docs, grades, 3))
    return found.select(
        "doc_id",
        F.col("graded.expected").alias("expected_grade"),
        F.col("graded.tail").alias("tail_probability"),
        (F.col("graded.tail") >= KEEP_TAIL).alias("kept"),
    )


def op8_benchmark_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bktree_simhash.simhash_groups(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.flagged(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(rows, "part", list("ABCDE"), ["good", "toxic"])


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(spark, _table(spark, sf_dir, "documents"))


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k"""

OP9_SQL = r"""WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
hit AS (SELECT win.doc_id, i FROM win JOIN firsts USING (s) WHERE f < win.doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM hit),
each AS (SELECT doc_id, w[j] AS x, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY each.j) FILTER (WHERE cov.j IS NULL) AS k, count(cov.j) AS n
  FROM each LEFT JOIN cov ON cov.doc_id = each.doc_id AND cov.j = each.j GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


OP11_SQL = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS f FROM w GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
  100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) AS c, regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(f < doc_id, false) AS e,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN firsts ON firsts.t = w.t LEFT JOIN marks USING (doc_id)),
p AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM d GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, bit)),
o AS (SELECT f1.l || f2.l || f3.l || f4.l || f5.l AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1 JOIN f f2 ON f2.l <> f1.l JOIN f f3 ON f3.l NOT IN (f1.l, f2.l) JOIN f f4 ON f4.l NOT IN (f1.l, f2.l, f3.l) JOIN f f5 ON f5.l NOT IN (f1.l, f2.l, f3.l, f4.l)),
s AS (SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS former FROM o, range(1, 6) AS r(i)),
x AS (SELECT part, filter_order, step, any_value(own) AS own,
  sum(n) FILTER (WHERE p.bits & (former | own) = 0) AS kept, sum(n) FILTER (WHERE p.bits & own > 0 AND p.bits & former = 0) AS removed,
  sum(n) FILTER (WHERE p.bits & own > 0 AND p.bits & former > 0) AS redundant, sum(n) FILTER (WHERE p.bits = own) AS unique_fails,
  sum(good) FILTER (WHERE p.bits & own > 0 AND p.bits & former = 0) AS good_lost, sum(toxic) FILTER (WHERE p.bits & own > 0 AND p.bits & former = 0) AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM x"""


OP12_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') || ' ' || least(len(w), 4) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
kinds AS (SELECT r, n, min(r) OVER (PARTITION BY n, k) AS node FROM (SELECT r, count(*) AS n, list(g ORDER BY g) AS k FROM s GROUP BY r)),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.r < y.r
  WHERE x.r IN (SELECT node FROM kinds) AND y.r IN (SELECT node FROM kinds) GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT node, r FROM kinds UNION SELECT r, node FROM kinds),
reach AS (SELECT r AS f, r AS t FROM n UNION SELECT f, e.b FROM reach JOIN e ON e.a = reach.t)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN reach ON f = d.r LEFT JOIN d o ON o.r = t GROUP BY d.r, d.doc_id"""

#: CRC-32 byte by byte, by a table made from its polynomial.
OP13_SQL = r"""WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
texts AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
w AS (SELECT row_number() OVER () AS r, doc_id, own,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
g AS (SELECT r, own, unnest(w) AS f FROM w
  UNION ALL SELECT r, own, w[i] || ' ' || w[i + 1] FROM (SELECT r, own, w, unnest(range(1, len(w))) AS i FROM w)),
kinds AS (SELECT f, hex(encode(f)) AS h FROM g GROUP BY f),
coded AS (SELECT f, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i::INT, 2))::BIGINT)), lambda c, z: xor(t[(xor(c, z) & 255) + 1], c >> 8))) % 10000 AS bucket FROM kinds, tab),
c AS (SELECT r, own, bucket, count(*) AS n FROM g JOIN coded USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM c GROUP BY 1),
sums AS (SELECT coalesce(sum(s), 0) + 10000 AS s_all, coalesce(sum(t), 0) + 10000 AS t_all FROM b),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * s_all) / ((s + 1) * t_all)))::BIGINT AS gain FROM b, sums),
d AS (SELECT r, sum(n) AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN gains USING (bucket) WHERE own GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (r) WHERE own),
o AS (SELECT doc_id, n_features, weight, score, n_words >= 20 AS able,
  row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * n // 100 THEN k END AS rank FROM o"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express whole; the others are tested against brute force."""
    return {"op6_stream_dedup": OP6_SQL, "op9_repeated_phrases": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_target_resample": OP13_SQL}

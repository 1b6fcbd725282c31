import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import windows
from netquarry.streaming import trailing

KIND = "src_ip string, dst_ip string, dst_port long, protocol string, ts timestamp, ordinal long, note string"
NAMES = [f.name for f in windows.FEATURES]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(trailing.PROVIDER, None)
    spark.conf.set(trailing.PROVIDER, trailing.ROCKS_DB)
    yield spark
    spark.conf.set(trailing.PROVIDER, before) if before else spark.conf.unset(trailing.PROVIDER)


def make_flows(rng, n, start=0, sources=4):
    out, second = [], 1_700_000_000.0 + start
    for i in range(n):
        second += rng.choice((0, 0, 0.5, 1, 3, 40))
        port = rng.choice((None, *range(80, 86))) if rng.random() < 0.9 else 9_007_199_254_740_993
        out.append((f"s{rng.randrange(sources)}", rng.choice(("d1", "d2", None)), port, rng.choice(("TCP", "TCP", "UDP", "ICMP")), second, start + i, "x"))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, KIND.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


def run(spark, tmp_path, batches, **options):
    for k, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = trailing.trailing_features(stream, late="1 hour", **options)
    query = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert len(query.recentProgress) >= len(batches)
    return {r.ordinal: [round(r[n], 9) for n in NAMES] for r in spark.read.parquet(f"{tmp_path}/out").collect()}


@pytest.mark.parametrize("chunk", [3, 256])
def test_stream_equals_batch(rocks, tmp_path, monkeypatch, chunk):
    """All five features over eight batches that cut instants apart; a queue in one chunk and in many."""
    monkeypatch.setattr(trailing, "CHUNK", chunk)
    rows = make_flows(random.Random(chunk), 400)
    want = windows.behaviour_features(table(rocks, rows).withColumn("micros", F.unix_micros("ts")), window_seconds=60)
    want = {r.ordinal: [round(r[n], 9) for n in NAMES] for r in want.collect()}
    assert len({tuple(v) for v in want.values()}) > 100
    assert run(rocks, tmp_path, [rows[k : k + 50] for k in range(0, 400, 50)], window_seconds=60) == want


def test_out_of_order_rows_raise(rocks, tmp_path):
    rows = make_flows(random.Random(1), 20, sources=1)
    late = [(*rows[3][:4], rows[3][4] - 5, 99, "late")]
    with pytest.raises(Exception, match="out of order"):
        run(rocks, tmp_path, [rows, late], window_seconds=60)


def test_needs_a_common_key_and_the_right_store(rocks):
    stream = rocks.readStream.format("rate").load().selectExpr("'a' AS src_ip", "'b' AS dst_ip", "1L AS dst_port", "'TCP' AS protocol", "timestamp AS ts", "value AS ordinal")
    apart = {"ports": windows.STREAMS["ports"], "pairs": windows.Stream(("dst_ip",), "dst_ip == dst_ip")}
    with pytest.raises(ValueError, match="in common"):
        trailing.trailing_features(stream, streams=apart)
    rocks.conf.unset(trailing.PROVIDER)
    with pytest.raises(ValueError, match="RocksDB"):
        trailing.trailing_features(stream)

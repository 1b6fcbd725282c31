from datetime import datetime, timedelta

from pyspark.sql import functions as F

from netquarry.operators import states
from netquarry.streaming import streams

KIND = "src_ip string, dst_port long, ts timestamp, bytes double"
T0 = datetime(2024, 1, 1)


def stream_of(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(s, p, T0 + timedelta(seconds=t), 1.0) for s, p, t in rows], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def run(query):
    query.awaitTermination()


def test_windowed_state(spark, tmp_path):
    src = stream_of(spark, tmp_path, [[("a", 1, 0), ("a", 2, 59)], [("b", 1, 60)], [("c", 1, 1000)]])
    out = streams.windowed_state(src, sums=["bytes"])
    run(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    rows = {r.window_start: r.flow_count for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows[T0] == 2 and rows[T0 + timedelta(seconds=60)] == 1


def test_hosts_and_edges_agree_with_the_batch(spark, tmp_path):
    rows = [(i % 5, (i * 7) % 4 if i % 9 else None, i % 3, float(i), T0 + timedelta(seconds=i * 2)) for i in range(200)]
    kind = "src long, dst long, dst_port long, bytes double, ts timestamp"
    last = [(1, 2, 3, 1.0, T0 + timedelta(hours=h)) for h in (2, 3)]  # they move the watermark on
    for i in range(4):
        spark.createDataFrame((rows + last[:1] + last[1:])[i * 51 : (i + 1) * 51], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    whole = states.with_window(spark.createDataFrame(rows, kind), "ts", "60 seconds")
    for name, batch in (("host_state", states.host_features(whole, sums=["bytes"], means=["bytes"])), ("edge_state", states.edge_table(whole, sums=["bytes"], means=["bytes"]))):
        src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = getattr(streams, name)(src, sums=["bytes"], means=["bytes"])
        run(out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start())
        found = spark.read.parquet(f"{tmp_path}/{name}").filter(F.col("window_start") < F.lit(T0 + timedelta(hours=1)))
        assert sorted(map(str, found.select(batch.columns).collect())) == sorted(map(str, batch.collect())) and found.count() > 10


def test_trailing_ports(spark, tmp_path):
    src = stream_of(spark, tmp_path, [[("a", 80, 0), ("a", 81, 1), ("a", 82, 2), ("a", 10, 2)], [("a", 80, 3), ("b", 1, 3)], [("a", 5, 302)]])
    out = streams.trailing_ports(src)
    run(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    rows = sorted((r.src_ip, r.ts, r.dst_port, r.dst_port_unique_cnt) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [(r[0], r[2], r[3]) for r in rows] == [("a", 80, 0), ("a", 81, 1), ("a", 10, 2), ("a", 82, 2), ("a", 80, 4), ("a", 5, 3), ("b", 1, 0)]


def test_resumable_append_replaces_a_batch(spark, tmp_path):
    write = streams.resumable_append(f"{tmp_path}/t", lambda df: df.withColumn("x", F.col("id") * 2))
    write(spark.range(3), 0)
    write(spark.range(5), 1)
    write(spark.range(4), 1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7

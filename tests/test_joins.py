import math
import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import joins

FIELDS = {k: k for k in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp", "duration")}


def packets(spark, rows):
    kind = "src_ip string, src_port int, dst_ip string, dst_port int, protocol string, at long, ttl int, tcp_window int, is_fragmented boolean, fragment_offset int, payload_length int"
    return spark.createDataFrame(rows, kind)


def test_packet_features(spark):
    start = 1_518_616_800_000_000
    flows = spark.createDataFrame(
        [
            ("f1", "a", "1", "b", "2", "6", "2018-02-14 14:00:00", "1000000"),
            ("f2", "a", "1", "b", "2", "17", "2018-02-14 14:00:00", "1000000"),
            ("f3", "c", "1", "d", "2", "6", "2018-02-14 14:00:00", "5000000"),
            ("bad", "c", "1", "d", "2", "99", "2018-02-14 14:00:00", "5"),
        ],
        "id string, " + ", ".join(f"{k} string" for k in FIELDS),
    )
    ready = joins.flow_windows(flows, FIELDS, {6: "TCP", 17: "UDP"})
    assert ready.count() == 3
    rows = [("a", 1, "b", 2, "TCP", start + i * 100_000, 60 + i, 100, i == 1, i * 8, p) for i, p in enumerate((1, 2, 4, 10))]
    rows += [("b", 2, "a", 1, "TCP", start + 1_000_000, 9, 7, None, None, 5), ("b", 2, "a", 1, "TCP", start + 1_000_001, 9, 7, None, None, 5)]
    last = F.lit(start + 2_000_000)
    found = {r.id: r for r in joins.packet_features(ready, packets(spark, rows), ["id"], last_packet=last, file_complete=False).collect()}
    f1 = found["f1"]
    assert (f1.ttl_fwd_min, f1.ttl_fwd_max, f1.ttl_bwd_mean, f1.ttl_bwd_std) == (60, 63, 9, 0)
    assert (f1.payload_median, f1.payload_p25, f1.payload_p75) == (4, 2, 5) and f1.fragmentation_count == 1 and f1.fragmentation_offset_max == 8
    assert found["f2"].tcp_window_fwd_mean == -1 and math.isnan(found["f2"].payload_mean)
    assert math.isnan(found["f3"].tcp_window_fwd_mean) and math.isnan(found["f3"].payload_mean)


def test_spread_matches_hand_values(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "v int")
    r = df.agg(*joins.spread(F.col("v"), F.lit(True), "x", joins.PAYLOAD_STATS)).first()
    assert (r.x_p25, r.x_median, r.x_p75) == (1.75, 3.0, 5.5) and r.x_std == pytest.approx(4.0311, abs=1e-4)
    with pytest.raises(ValueError):
        joins.spread(F.col("v"), F.lit(True), "x", ("mode",))


def test_interval_join_buckets_agree(spark):
    a = spark.range(200).selectExpr("id % 5 k", "id * 3 s", "id * 3 + id % 40 e", "id i")
    b = spark.range(300).selectExpr("id % 5 k", "id * 2 t", "id j")
    plain = joins.interval_join(a, b, ["k"], "s", "e", "t").select("i", "j")
    for bucket in (1, 7, 1000):
        cut = joins.interval_join(a, b, ["k"], "s", "e", "t", bucket=bucket).select("i", "j")
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    assert joins.interval_join(a, b.limit(0), ["k"], "s", "e", "t", how="left").count() == 200


def test_extremes_of_intervals_without_pairs(spark):
    rng = random.Random(3)
    few = [(rng.choice([1, 2, None]), s, s + rng.choice([-3, 0, 1, 7, 60, 10**15]), i) for i, s in enumerate(rng.choices(range(50), k=80))]
    many = [(rng.choice([1, 2, None]), rng.choice([*range(60), None]), i) for i in range(150)]
    a, b = spark.createDataFrame(few, "k long, s long, e long, i long"), spark.createDataFrame(many, "k long, t long, j long")
    got = {r.i: (r.points, r["first"], r["last"]) for r in joins.interval_extremes(a, b, ["k"], "s", "e", "t", "j").collect()}
    for k, s, e, i in few:
        inside = [j for q, t, j in many if k is not None and q == k and t is not None and s <= t <= e]
        assert got.pop(i) == (len(inside), min(inside, default=None), max(inside, default=None))
    assert not got
    # 30,000 intervals of 30,000 points each: 900 million pairs
    wide = joins.interval_extremes(spark.range(30_000).selectExpr("0 k", "id - 30000 s", "id + 30000 e"), spark.range(30_000).selectExpr("0 k", "id t"), ["k"], "s", "e", "t", "t")
    assert wide.agg(F.sum("points"), F.sum("first"), F.sum("last")).first()[:] == (30_000 * 30_000, 0, 30_000 * 29_999)


def test_merge_levels(spark):
    flow = spark.createDataFrame([("x", 1, "f1"), ("x", 2, "f2"), ("y", 3, "f3")], "k string, n int, f string")
    cross = spark.createDataFrame([("x", 5, "c1"), ("x", 6, "c2"), ("y", 7, "c3")], "k string, n int, c string")
    packet = spark.createDataFrame([("x", 1, "p1")], "k string, n int, p string")
    rows = sorted((r.f, r.c, r.p) for r in joins.merge_levels(flow, cross, packet, ["k"], "n").collect())
    assert rows == [("f1", "c1", "p1"), ("f2", "c2", None), ("f3", "c3", None)]
    with pytest.raises(Exception, match="without its"):
        joins.merge_levels(flow, cross.limit(2), packet, ["k"], "n").collect()
    with pytest.raises(ValueError, match="twice"):
        joins.merge_levels(flow, cross.withColumnRenamed("c", "f"), packet, ["k"], "n")


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k int, y string")
    rows = sorted(map(tuple, joins.upsert_providers([a, b], ["k"], ["k", "x", "y"], "-").collect()))
    assert rows == [(1, "a", "b"), (2, "c", "z"), (3, "-", "-")]
    with pytest.raises(Exception, match="twice"):
        joins.upsert_providers([a.union(a), b], ["k"], ["k", "x", "y"]).collect()


def test_tables_side_by_side(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "place int, id string, x int")
    right = spark.createDataFrame([(2, "b", 8), (1, "a", 7)], "place int, id string, y int")
    assert sorted(tuple(r) for r in joins.aligned(left, right, "place", ["id"]).select("place", "id", "x", "y").collect()) == [(1, "a", 5, 7), (2, "b", 6, 8)]
    for bad in (right.limit(1), right.withColumn("id", F.lit("a"))):
        with pytest.raises(Exception, match="length|differ"):
            joins.aligned(left, bad, "place", ["id"]).collect()
    with pytest.raises(ValueError, match="twice"):
        joins.aligned(left, right, "place")


def test_intervals_of_every_length_by_classes(spark):
    """Lengths from nothing to the whole range of a long, ends before starts, nulls; the same as a plain join, left outer too."""
    rng = random.Random(12)
    top = 2**63 - 1
    rows = [(i, rng.randrange(3), (s := rng.randint(-1000, 1000)), s + rng.choice((0, 1, 3, 50, 4000, -2))) for i in range(120)]
    rows += [(900, 0, 5, top), (901, 1, -top, top), (902, 2, None, 5), (903, 0, 7, None), (904, None, 0, 10)]
    dots = [(rng.randrange(3), rng.randint(-1200, 1200), f"p{i}") for i in range(150)] + [(0, None, "none"), (None, 5, "null")]
    left = spark.createDataFrame(rows, "id int, k int, s long, e long")
    right = spark.createDataFrame(dots, "k int, t long, name string")
    for how in ("inner", "left"):
        want = sorted((r.id, r.t, r.name) for r in joins.interval_join(left, right, ["k"], "s", "e", "t", how=how).collect() if r.name or how == "left")
        for bucket in (1, 7, 10_000):
            got = joins.interval_join(left, right, ["k"], "s", "e", "t", bucket=bucket, how=how)
            assert sorted(((r.id, r.t, r.name) for r in got.collect()), key=str) == sorted(want, key=str)
            assert got.columns[:4] == left.columns
    assert joins.interval_join(left.limit(0), right, ["k"], "s", "e", "t", bucket=5).count() == 0
    with pytest.raises(ValueError, match="inner or left"):
        joins.interval_join(left, right, ["k"], "s", "e", "t", how="full")


def test_a_corrupt_duration_makes_no_rows(spark):
    flows = spark.createDataFrame([("a", 1, "b", 2, 6, "2020-01-01 00:00:00", 2**63 - 1), ("a", 1, "b", 2, 6, "2020-01-01 00:00:00", 5)], "s string, p int, d string, q int, n int, at string, long bigint")
    fields = {"src_ip": "s", "src_port": "p", "dst_ip": "d", "dst_port": "q", "protocol": "n", "timestamp": "at", "duration": "long"}
    assert [r.long for r in joins.flow_windows(flows, fields, {6: "TCP"}).collect()] == [5]

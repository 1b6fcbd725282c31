import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netquarry.operators import packing, profile, scaling, setops, states

T0 = datetime(2024, 1, 1)


def flows(spark, rows):
    kind = "ts timestamp_ntz, src string, dst string, dst_port bigint, protocol int, bytes double, label string"
    return states.with_window(spark.createDataFrame([(T0 + timedelta(seconds=t), *r) for t, *r in rows], kind))


ROWS = [
    (0, "a", "b", 1, 6, 10.0, "ok"), (1, "a", "c", 2, 17, 20.0, "ok"), (59, "c", "b", 1, 6, 30.0, "bad"), (60, "b", "a", 1, 0, 5.0, "ok"), (200, "a", "b", 1, 6, 1.0, "ok"), (201, None, "b", 1, 6, 1.0, "ok"),
]


def test_global_and_delta(spark):
    g = states.global_state(flows(spark, ROWS), unique=["src", "dst"], sums=["bytes"], means=["bytes"], stds=["bytes"], maxima=["bytes"])
    rows = g.orderBy("window_start").collect()
    assert [r.flow_count for r in rows] == [3, 1, 2] and rows[1].bytes_std == 0 and rows[2].src_unique == 1
    assert rows[0].protocol_6_ratio == pytest.approx(2 / 3)
    d = states.delta_global(g, ["flow_count"]).orderBy("window_start").collect()
    assert [r.delta_flow_count for r in d] == [0, -2, 1]


def test_hosts_edges_and_tensors(spark):
    f = flows(spark, ROWS)
    hosts = states.host_features(f, sums=["bytes"], means=["bytes"], ratios=["protocol"])
    top = states.top_hosts(hosts, 2)
    first = [r for r in top.orderBy("window_start", "place").collect()][:2]
    assert [r.host for r in first] == ["a", "b"]  # a, b and c have two flows each: ties by host
    assert hosts.filter("host is null").count() == 0
    delta = {(r.window_start.minute, r.host): r.delta_out_bytes_sum for r in states.delta_host(top, ["out_bytes_sum"]).collect()}
    assert delta[(0, "a")] == 0 and delta[(1, "b")] == 5 and delta[(1, "a")] == -30
    edges = states.edges_between(states.edge_table(f, sums=["bytes"]), top)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b"), ("b", "a")}
    both = states.undirected(edges, extra=("i", "j"))
    assert both.count() == 2 * edges.count()
    padded = states.padded_hosts(top, 4).filter(F.minute("window_start") == 0).orderBy("place").collect()
    assert [r["mask"] for r in padded] == [1, 1, 0, 0] and [r.host for r in padded][2:] == ["pad_0", "pad_1"]
    g = states.global_state(f, unique=["src"], means=["bytes"])
    t = states.window_tensors(g, top, edges, global_columns=["flow_count"], host_columns=["out_bytes_sum"], edge_columns=["bytes_sum"], k=3).orderBy("window_start").first()
    assert t["host_mask"] == [1, 1, 0] and t["adjacency"][0][1] == 1 and t["edge"][0][1] == [10.0] and len(t["edge"]) == 3


def test_labels(spark):
    rows = states.window_labels(flows(spark, ROWS), ["bad", "worse"], benign="ok").orderBy("window_start").collect()
    assert [(r.attack_presence, r.attack_types_present) for r in rows] == [(1, [1, 0]), (0, [0, 0]), (0, [0, 0])]
    with pytest.raises(Exception, match="unknown label"):
        states.window_labels(flows(spark, ROWS), ["worse"], benign="ok").collect()


def test_clean_numbers(spark):
    df = spark.createDataFrame([("1", math.nan, "k"), ("x", math.inf, None)], "a string, b double, id string")
    assert [tuple(r) for r in states.clean_numbers(df, ["id"]).collect()] == [(1.0, 0.0, "k"), (0.0, 0.0, None)]


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "window_start int, x double, c double")
    s = {r.name: (r["mean"], r["std"]) for r in scaling.fit_scaler(df, ["x", "c"]).collect()}
    assert s == {"x": (2, 1), "c": (5, 1)}
    big = df.union(spark.createDataFrame([(3, 1e9, 5.0)], df.schema))
    assert [r.x for r in scaling.apply_scaler(big, scaling.fit_scaler(df, ["x", "c"]), ["x", "c"]).orderBy("window_start").collect()] == [-1, 1, 10]
    assert scaling.fit_scaler(df.limit(0), ["x"]).first()["std"] == 1
    assert scaling.apply_scaler(df, None, ["x"], enabled=False) is df
    assert [r.train for r in scaling.training_windows(spark.range(10).withColumnRenamed("id", "window_start")).orderBy("window_start").collect()] == [True] * 7 + [False] * 3


def test_packing(spark):
    assert packing.plan_batches([12, 9, 25, 3, 10], 20) == [0, 1, 2, 3, 3]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([12, 9, 25, 3, 10])], "i int, size long")
    assert [r.batch for r in packing.with_batches(df, ["i"], "size", 20).orderBy("i").collect()] == [0, 1, 2, 3, 3]


def test_bags_and_overlap(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "v string") for t in ("xxy", "xz"))
    r = setops.bag_similarity(a, b, ["v"]).first()
    assert (r.similarity, round(r.a_in_b, 4), r.b_in_a) == (0.25, 0.3333, 0.5)
    assert setops.bag_similarity(a.limit(0), b.limit(0), ["v"]).first().similarity == 1
    over = lambda *x: spark.range(1).select(setops.time_overlap(*[F.lit(v) for v in x]).alias("o")).first().o
    assert over(0, 10, 5, 15) == pytest.approx(1 / 3) and over(3, 3, 3, 3) == 1 and over(0, 1, 5, 6) == 0
    with pytest.raises(ValueError):
        setops.union_all([a, b.withColumnRenamed("v", "u")])


def test_profile(spark):
    df = spark.createDataFrame([("1", "2"), ("a", "b"), ("-3", "2")], "a string, b string")
    v = profile.numeric_view(df)
    assert v.count() == 2 and profile.header_count(df).first()[0] == 1
    assert [tuple(r) for r in profile.negatives(v, ["a", "b"]).collect()] == [("a", 1)]
    assert [tuple(r) for r in profile.constants(v, ["a", "b"]).collect()] == [("b", 2.0)]
    assert profile.finite_rows(v.withColumn("a", F.lit(math.inf)), ["a"]).count() == 0
    assert {r["column"]: r.p50 for r in profile.describe(v, ["a", "b"]).collect()} == {"a": -1.0, "b": 2.0}


def test_packing_bounds_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, 30), (2, 5)], "i int, size long")
    assert sorted((str(r.i), r.batch) for r in packing.with_batches(df, ["i"], "size", 20).collect()) == [("1", 1), ("2", 1), ("None", 0)]
    with pytest.raises(Exception, match="more than 2"):
        packing.with_batches(df, ["i"], "size", 20, most=2).collect()
    assert packing.with_batches(df.limit(0), ["i"], "size", 20).count() == 0

import math
import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import windows as w

KIND = "src_ip string, dst_ip string, dst_port bigint, protocol string, micros bigint, ordinal bigint"


def features(spark, points, **kw):
    rows = [("s", "d", p, "TCP", int(t * 1_000_000), i) for i, (t, p) in enumerate(points)]
    found = w.behaviour_features(spark.createDataFrame(rows, KIND), **kw).orderBy("ordinal").collect()
    return [tuple(round(r[f.name], 6) for f in w.FEATURES) for r in found]


def test_hand_computed_history(spark):
    got = features(spark, [(0, 80), (1, 81), (2, 82), (2, 10), (3, 80)])
    # unique, scan rate, sequentiality, entropy, pair rate
    assert got == [(0, 0, 0, 0, 0), (1, 1000, 0, 0, 1000), (2, 2, 1 if got[2][2] == 1 else 0, 1, 2), (2, 2, got[3][2], 1, 2), (4, 2, 1, 2, 2)]


@pytest.mark.parametrize(("ports", "value"), [([1, 2, 3, 10], 1.0), ([1, 2, 1], 0.0), ([5, 9], 0.0), ([3, 2, 1, 2, 3], 1.0)])
def test_sequentiality(spark, ports, value):
    points = [(i, p) for i, p in enumerate(ports)] + [(50, 7)]
    assert features(spark, points)[-1][2] == value


def test_frame_ends(spark):
    got = features(spark, [(0, 1), (300, 2), (300.000001, 3), (601, 4)])
    assert [g[0] for g in got] == [0, 1, 1, 0]


def test_ineligible_rows_see_but_do_not_count(spark):
    rows = [("s", "d", 1, "ICMP", 0, 0), ("s", None, 2, "UDP", 1_000_000, 1), (None, "d", 3, "TCP", 2_000_000, 2), ("s", "d", None, "TCP", 3_000_000, 3), ("s", "d", 4, "ICMP", 4_000_000, 4)]
    found = w.behaviour_features(spark.createDataFrame(rows, KIND)).orderBy("ordinal").collect()
    assert [r.dst_port_unique_cnt for r in found] == [0, 0, 0, 1, 1]
    assert [r.src_dst_pair_flow_rate > 0 for r in found] == [False, False, False, True, True]


def brute(rows, span):
    """All five features of each row, from its frame read anew."""
    out = {}
    for src, dst, _, _, at, order in rows:
        frame = sorted((r[4], r[5], r[2]) for r in rows if r[0] == src is not None and r[3] in ("TCP", "UDP") and r[2] is not None and at - span <= r[4] < at)
        ports = [p for _, _, p in frame]
        pairs = [r[4] for r in rows if r[0] == src is not None and r[1] == dst is not None and at - span <= r[4] < at]
        seconds = lambda times: max(max(times) - min(times), 1000) / 1e6
        steps = [b - a for a, b in zip(ports, ports[1:])]
        right = [abs(d) == 1 for d in steps]
        strong = [r and (d in steps[i - 1 : i][-1:] if i else False) or r and i + 1 < len(steps) and steps[i + 1] == d for i, (d, r) in enumerate(zip(steps, right))]
        touch = lambda marks: sum(any(marks[max(i - 1, 0) : i + 1]) for i in range(len(ports)))  # noqa: B023, E731
        shares = [ports.count(p) / len(ports) for p in set(ports)]
        out[order] = (
            len(set(ports)),
            len(set(ports)) / seconds([t for t, _, _ in frame]) if frame else 0,
            touch(strong) / touch(right) if touch(right) else 0,
            -sum(x * math.log2(x) for x in shares),
            len(pairs) / seconds(pairs) if pairs else 0,
        )
    return out


@pytest.mark.parametrize(("seed", "span", "chunks"), [(1, 20, 1), (2, 7, 2), (3, 50, 8), (4, 1000, 1)])
def test_all_features_against_frames_read_anew(spark, seed, span, chunks):
    rng = random.Random(seed)
    rows = []
    for i in range(350):
        src = rng.choice(["hot", "hot", "a", "b", None])
        port = rng.choice([None, 1, 2, 3, 4, 5]) if rng.random() < 0.6 else (i // 2) % 9
        rows.append((src, rng.choice(["x", "y", None]), port, rng.choice(["TCP", "UDP", "ICMP"]), rng.randrange(120) * 1_000_000, i))
    df = spark.createDataFrame(rows, KIND).withColumn("_x", F.lit("kept"))
    found = w.behaviour_features(df, window_seconds=span, chunk_windows=chunks)
    assert found.columns == [*df.columns, *[f.name for f in w.FEATURES]]
    want = brute(rows, span * 1_000_000)
    got = {r.ordinal: [r[f.name] for f in w.FEATURES] for r in found.collect()}
    assert len(got) == len(rows)
    for order, values in want.items():
        assert got[order] == pytest.approx(values, abs=1e-7), (rows[order], order)


def test_rows_without_a_time_and_no_rows(spark):
    rows = [("s", "d", 1, "TCP", None, 0), ("s", "d", 2, "TCP", 5, 1), ("s", "d", 3, "TCP", 1_000_005, 2)]
    got = {r.ordinal: (r.dst_port_unique_cnt, r.dst_port_entropy) for r in w.behaviour_features(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (1, 0)}
    assert w.behaviour_features(spark.createDataFrame([], KIND)).count() == 0


def test_unknown_statistic(spark):
    with pytest.raises(ValueError, match="unknown"):
        w.behaviour_features(spark.createDataFrame([], KIND), features=[w.Feature("x", "ports", "mode", "count")])


def test_distinct_values_are_counted_from_few_rows_of_an_instant(spark):
    # one source, 200,000 rows in 4 instants: no window holds more than its distinct rows
    rows = spark.range(200_000).selectExpr("'s' src_ip", "'d' dst_ip", "id % 7 + id % 4 * 100 dst_port", "'TCP' protocol", "id % 4 * 1000000 micros", "id ordinal")
    chosen = [f for f in w.FEATURES if f.statistic in ("unique_count", "span_rate_unique")]
    found = w.behaviour_features(rows, features=chosen)
    assert [tuple(r) for r in found.groupBy("micros", *[f.name for f in chosen]).count().orderBy("micros").collect()] == [
        (0, 0, 0, 50_000), (1_000_000, 7, 7000, 50_000), (2_000_000, 14, 14, 50_000), (3_000_000, 21, 10.5, 50_000)
    ]
    held = "\n".join(line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line or "Window" in line)
    assert held.rindex("Window") < held.rindex("Aggregate")
    rng = random.Random(9)
    points = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([None, 1, 2, 3]), rng.choice(["TCP", "UDP", "ICMP"]), rng.randrange(9) * 1_000_000, i) for i in range(300)]
    points.append(("a", "x", 1, "TCP", None, 300))
    df = spark.createDataFrame(points, KIND)
    every = {r.ordinal: r for r in w.behaviour_features(df, window_seconds=3).collect()}
    for r in w.behaviour_features(df, features=chosen, window_seconds=3).collect():
        assert all(r[f.name] == every[r.ordinal][f.name] for f in chosen)


def test_a_hot_source_is_put_together_by_instants(spark, monkeypatch):
    # one source, 60,000 rows in 4 instants: what is dealt by source and chunk is a few rows of each
    seen = []
    for name in ("_with_ends", "_with_moves"):
        made = getattr(w, name)
        monkeypatch.setattr(w, name, lambda rows, *rest, made=made: seen.append(rows.count()) or made(rows, *rest))
    rows = spark.range(60_000).selectExpr("'s' src_ip", "'d' dst_ip", "id div 4 % 5 dst_port", "'TCP' protocol", "id % 4 * 1000000 micros", "id ordinal")
    found = w.behaviour_features(rows, window_seconds=2).groupBy("micros", *[f.name for f in w.FEATURES]).count().orderBy("micros").collect()
    assert [tuple(round(x, 6) for x in r) for r in found] == [
        (0, 0, 0, 0, 0, 0, 15_000), (1_000_000, 5, 5000, 1, 2.321928, 15_000_000, 15_000),
        (2_000_000, 5, 5, 1, 2.321928, 30_000, 15_000), (3_000_000, 5, 5, 1, 2.321928, 30_000, 15_000),
    ]
    assert len(seen) == 3 and max(seen) <= 4 * 2 * 8 * 2


@pytest.mark.parametrize("seed", range(3))
def test_many_members_of_an_instant_against_frames_read_anew(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 7, 15, 16, 17, 18, 40]) for _ in range(9)]
    points = [(k, (i // rng.choice([1, 2]) if rng.random() < 0.7 else rng.randrange(5)) % 7) for k, n in enumerate(sizes) for i in range(n)]
    rows = [(rng.choice(["s", "s", "s", "t"]), rng.choice(["x", "y"]), p, rng.choice(["TCP", "TCP", "TCP", "ICMP"]), k * 1_000_000, i) for i, (k, p) in enumerate(points)]
    found = w.behaviour_features(spark.createDataFrame(rows, KIND), window_seconds=3, chunk_windows=2)
    want = brute(rows, 3_000_000)
    got = {r.ordinal: [r[f.name] for f in w.FEATURES] for r in found.collect()}
    assert len(got) == len(rows)
    for order, values in want.items():
        assert got[order] == pytest.approx(values, abs=1e-7), (rows[order], order)

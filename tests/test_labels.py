from datetime import datetime

import pytest

from netquarry.operators import labels as lb

KIND = "`Flow ID` string, `Timestamp` string, `Source IP` string, `Destination IP` string, `Destination Port` string, `Protocol` string, `Total Length of Fwd Packets` string, `Source Port` string"
T = "2018-02-14 14:00:00"


def flow(**over):
    base = {"id": "f", "t": T, "s": "1.1.1.1", "d": "2.2.2.2", "p": "80", "proto": "6", "len": "0", "sp": "5"} | over
    return tuple(base[k] for k in ("id", "t", "s", "d", "p", "proto", "len", "sp"))


def labelled(spark, rules, *rows, **kw):
    return [r.Label for r in lb.label_flows(spark.createDataFrame(list(rows), KIND), rules, **kw).collect()]


def rule(label="A", **over):
    return lb.AttackRule(label, datetime(2018, 2, 14, 14), datetime(2018, 2, 14, 15), **over)


def test_last_match_wins_and_ends_count(spark):
    rules = [rule("A"), rule("B")]
    rows = [flow(), flow(t="2018-02-14 15:00:00.000000"), flow(t="2018-02-14 15:00:00.000001"), flow(proto="1"), flow(id="x")]
    assert labelled(spark, rules, *rows, artifacts=("x",)) == ["B", "B", "Benign", "Benign"]


def test_sets_protocol_payload_and_conditions(spark):
    assert labelled(spark, [rule(src_ips=("1.1.1.1",), dst_ports=(80, 81), protocol=6, payload_filter=True)], flow(), flow(len="3"), flow(p="79")) == ["A", "Benign", "Benign"]
    assert labelled(spark, [rule(dst_ips=())], flow()) == ["Benign"]
    ne = ({"feature": "Source Port", "op": "ne", "value": 68},)
    assert labelled(spark, [rule(conditions=ne)], flow(), flow(sp="68"), flow(sp="none")) == ["A", "Benign", "Benign"]
    tree = ({"any_of": [{"feature": "Source IP", "op": "eq", "value": "9.9.9.9"}, {"all_of": [{"feature": "Source Port", "op": "in", "value": [5, 6]}]}]},)
    assert labelled(spark, [rule(conditions=tree)], flow(), flow(sp="7")) == ["A", "Benign"]


def test_schedule():
    days = {"days": [{"attacks": [{"rules": [{"label": "A", "start": "2018-02-14T14:00:00.5Z", "finish": "2018-02-14T15:00:00Z", "protocol": "udp", "dst_ports": []}]}]}]}
    (found,) = lb.load_schedule(days)
    assert found.start == datetime(2018, 2, 14, 14, 0, 0, 500000) and found.protocol == 17 and found.dst_ports == () and found.src_ips is None


def test_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert lb.renamed(df, {"x": "a", "y": "a"}).columns == ["x", "y"]
    with pytest.raises(ValueError, match="c"):
        lb.renamed(df, {"x": "c"})


def test_a_table_of_rules_labels_like_compiled_rules(spark):
    """Sets that are empty or absent, conditions, artifacts, times of one instant and of years; 5,000 rules leave the plan as it is."""
    import random
    from datetime import timedelta

    rng = random.Random(6)
    day = datetime(2020, 1, 1)
    trees = [{"feature": "size", "op": "gte", "value": 5}, {"any_of": [{"feature": "name", "op": "eq", "value": "x"}, {"feature": "size", "op": "lt", "value": 2}]}]
    maybe = lambda *options: rng.choice((None, None, *options))

    def rule(i):
        start = day + timedelta(seconds=rng.randrange(2_000_000))
        length = timedelta(seconds=rng.choice((0, 1, 60, 5000, 400_000, -3)))
        return lb.AttackRule(
            f"l{i % 40}", start, start + length, maybe(("a", "b"), ()), maybe(("c",)), maybe((80, 443), ()), maybe(6, 17), rng.random() < 0.2, tuple(rng.sample(trees, rng.choice((0, 0, 1, 2)))),
        )

    rules = [rule(i) for i in range(60)]
    rows = [
        (f"f{i}", rng.choice((day + timedelta(seconds=rng.randrange(2_100_000)), rng.choice(rules).start, None)), rng.choice(("a", "z", None)), rng.choice(("c", "d")), rng.choice((80, 5, None)),
         rng.choice((6, 17, 1)), rng.choice((0.0, 3.0)), rng.choice((None, 1, 4, 9)), rng.choice(("x", "y")))
        for i in range(800)
    ]
    kind = "id string, t timestamp, s string, d string, p int, proto int, bytes double, size int, name string"
    flows = spark.createDataFrame(rows, kind)
    columns = lb.FlowColumns("t", "id", "s", "d", "p", "proto", "bytes")
    options = {"columns": columns, "artifacts": ("f3", "f4"), "default": "none"}
    want = {r.id: r.Label for r in lb.label_flows(flows, rules, **options).collect()}
    table, found = lb.rule_table(spark, rules)
    made = lb.label_by_table(flows, table, found, **options)
    assert {r.id: r.Label for r in made.collect()} == want and len(set(want.values())) > 10 and made.columns == [*flows.columns, "Label"]
    assert {r.Label for r in lb.label_by_table(flows, table.limit(0), **options).collect()} == {"none"}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    many = lb.label_by_table(flows, lb.rule_table(spark, [rule(i) for i in range(5000)])[0], trees, **options)
    assert plan(many) <= plan(made) + 1 and many.count() == len(want)


def test_rules_that_all_lie_at_one_time_are_not_tested_one_by_one(spark):
    # 30,000 flows within 30,000 rules' time: 900 million pairs
    flows = spark.range(30_000).selectExpr("timestamp_seconds(1500000000 + id) t", "id", "'a' s", "'b' d", "cast(id as int) p", "'6' n", "0 l")
    rules = spark.range(30_000).selectExpr(
        "id ordinal", "concat('r', id) label", "timestamp_seconds(1400000000) start", "timestamp_seconds(1600000000 - id) finish", "array('a') src_ips",
        "cast(null as array<string>) dst_ips", "array(cast(id as int), cast(id + 1 as int)) dst_ports", "6 protocol", "false payload_filter", "cast(null as array<int>) conditions",
    )
    found = lb.label_by_table(flows, rules, columns=lb.FlowColumns("t", "id", "s", "d", "p", "n", "l"), default="none")
    assert found.filter("Label <> concat('r', id)").count() == 0 and found.count() == 30_000

import json

import pytest
from pyspark.sql import functions as F

from netquarry.operators import labels
from netquarry.operators.quality import Numeric, Text
from netquarry.plans import config, job_queries, jobs
from netquarry.sources import pcap, tables


def test_configuration_is_read_or_refused(spark, tmp_path):
    plan = config.plan_from(config.parse_config(job_queries.CLEAN))
    assert plan.schema["l_tax"] == Numeric(allow_negative=True, minimum=0, maximum=1, sentinel=(-1,)) and plan.schema["l_returnflag"] == Text()
    assert plan.non_repairable == {"l_quantity", "l_discount", "stamp"} and plan.formulas == {"rate": "l_extendedprice / l_quantity"}
    assert config.parse_config(json.dumps({"a": [1]})) == {"a": [1]}
    for text in ("a: [1", "- 1\n- 2", "12"):
        with pytest.raises(ValueError, match="neither|no mapping"):
            config.parse_config(text)
    with pytest.raises(ValueError, match="unknown entries of a rule"):
        config.plan_from({"columns": {}, "rules": [{"id": "x", "expression": "a > 1", "targets": "a"}]})
    with pytest.raises(ValueError, match="don't exist"):
        config.plan_from({"columns": {"a": None}, "repairable_rules": ["R1"]})
    with pytest.raises(ValueError, match="unknown type"):
        config.column_check("a", {"type": "number"})
    path = tmp_path / "states.yaml"
    path.write_text(job_queries.STATES)
    states = config.states_from(config.read_config(spark, str(path)))
    assert states.k == 10 and states.hosts.sums == ("bytes",) and states.columns.timestamp == "ts"
    with pytest.raises(ValueError, match="unknown streams"):
        config.history_from({"streams": {}, "features": [{"name": "n", "stream": "s", "statistic": "entropy", "formula": "entropy_sum"}]})
    streams, features, _, seconds = config.history_from(
        {"streams": {"s": {"group_by": ["src_ip"], "eligible": "dst_port > 1", "value": "dst_port"}}, "features": [{"name": "n", "stream": "s", "statistic": "unique_count", "formula": "count"}]}
    )
    assert streams["s"].group_by == ("src_ip",) and features[0].missing == 0.0 and seconds == 300


def test_clean_job_reports_each_cycle(spark, tmp_path):
    rows = [("1", "10", "2", "5.0"), ("2", "10", "2", "7.0"), ("3", "-1", "2", "5.0"), ("id", "a", "b", "r"), ("1", "10", "2", "5.0")]
    spark.createDataFrame(rows, "id string, ` a ` string, b string, r string").write.option("header", True).csv(f"{tmp_path}/raw")
    plan = config.plan_from(
        {
            "columns": {"id": {"integer": True}, "a": {}, "b": {}, "r": {}},
            "rules": [{"id": "r", "expression": "r == a / b", "target": "r"}],
            "formulas": {"r": "a / b"},
            "repairable_rules": ["r"],
            "ignored": ["id"],
        }
    )
    out = jobs.clean_job(spark, f"{tmp_path}/raw", f"{tmp_path}/clean", plan, reports=f"{tmp_path}/reports")
    assert sorted((r.id, r.r) for r in out.collect()) == [(1, 5.0), (2, 5.0)]
    found = {(r.cycle, r.kind, r.name): int(r["count"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/reports").collect()}
    assert found[(0, "row", "repairable")] == 1 and found[(0, "row", "dropped")] == 1 and found[(1, "row", "valid")] == 2
    with pytest.raises(ValueError, match="missing"):
        jobs.clean_job(spark, f"{tmp_path}/raw", f"{tmp_path}/clean2", config.plan_from({"columns": {"z": None}}))


def test_label_job_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:05", "b", "6"), ("2024-01-01 00:00:05", "a", "17"), ("2024-01-01 00:00:01", "c", "6"), ("2024-01-02 00:00:00", "d", "1")]
    spark.createDataFrame([(*r, "x", "y", "1", "0") for r in rows], "Timestamp string, `Flow ID` string, Protocol string, `Source IP` string, `Destination IP` string, `Destination Port` string, `Total Length of Fwd Packets` string").write.option("header", True).csv(f"{tmp_path}/raw")
    rules = [labels.AttackRule("attack", labels.utc("2024-01-01T00:00:05Z"), labels.utc("2024-01-01T00:00:06Z"))]
    done = jobs.label_job(spark, f"{tmp_path}/raw", f"{tmp_path}/out", rules)
    assert (done.rows, done.dropped, done.by_label) == (3, 1, {"attack": 2, "Benign": 1})
    assert [r["Flow ID"] for r in tables.read_csv(spark, f"{tmp_path}/out").collect()] == ["c", "a", "b"]


def test_states_without_any_time_raise(spark):
    plan = config.states_from({"columns": {"timestamp": "ts"}, "numbers": ["bytes"], "sums": ["bytes"]})
    kind = "src string, dst string, dst_port long, protocol long, ts string, label string, bytes double"
    with pytest.raises(ValueError, match="no time"):
        jobs.build_states(spark.createDataFrame([("a", "b", 1, 6, "soon", "ok", 1.0)], kind), plan)
    made = jobs.build_states(spark.createDataFrame([("a", "b", 1, 6, "2024-01-01 00:00:00", "ok", 1.0)], kind), plan)
    assert made.windows.count() == 1 and made.labels is None and "delta_flow_count" not in made.windows.columns
    assert jobs.build_states(spark.createDataFrame([], kind), plan).hosts.count() == 0


def test_extract_job(spark, tmp_path):
    from tests.test_sources import ether, ipv4, tcp

    frames = [ether(ipv4(tcp(b"x" * n), 6)) for n in (5, 10)]
    data = pcap.classic_bytes((1_700_000_000_000_000 + i * 1_000_000, len(f), len(f), f) for i, f in enumerate(frames))
    (tmp_path / "a.pcap").write_bytes(data)
    kind = "id long, a string, ap string, b string, bp string, p string, t string, d string"
    flows = spark.createDataFrame(
        [(1, "10.0.0.1", "1234", "10.0.0.2", "80", "6", "2023-11-14 22:13:20", "2000000"), (2, "10.0.0.1", "1234", "10.0.0.9", "81", "6", "2023-11-14 22:13:21", "1"), (3, "x", "y", "z", "80", "6", "never", "1")],
        kind,
    )
    fields = {"src_ip": "a", "src_port": "ap", "dst_ip": "b", "dst_port": "bp", "protocol": "p", "timestamp": "t", "duration": "d"}
    found = {r.id: r for r in jobs.extract_job(spark, str(tmp_path / "*.pcap"), flows, fields, {6: "TCP"}, ["id"], history={"window_seconds": 60}).collect()}
    assert set(found) == {1, 2}
    assert (found[1].payload_min, found[1].payload_max, found[1].ttl_bwd_mean) == (5, 10, -1)
    assert found[2].payload_mean != found[2].payload_mean  # no packets: NaN
    assert (found[1].dst_port_unique_cnt, found[2].dst_port_unique_cnt) == (0, 1)
    assert jobs.extract_job(spark, str(tmp_path / "*.pcap"), flows, fields, {6: "TCP"}, ["id"]).filter(F.col("id") == 1).count() == 1

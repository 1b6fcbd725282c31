from pyspark.sql import functions as F

from netquarry.operators import quality as q
from netquarry.plans.flow_plan import DROPPED, SCHEMA, TEXTS, VALID_LABELS, flow_plan


def flow(spark, **over):
    row = {c: 1.0 for c in SCHEMA if c not in TEXTS} | {c: "x" for c in TEXTS}
    row |= {"Timestamp": "2018-02-14 14:00:00", "Label": "Benign", "Protocol": 6.0, "Flow Duration": 1_000_000.0}
    row |= {"Flow Bytes/s": 2.0, "Flow Packets/s": 2.0}
    return spark.createDataFrame([row | over], ", ".join(f"`{c}` {'string' if c in TEXTS else 'double'}" for c in sorted(row)))


def test_a_sound_flow_passes_whole_cleaning(spark):
    plan = flow_plan("expression")
    raw = flow(spark).withColumns({c: F.lit("1") for c in DROPPED})
    df = q.initial_cleanup(raw, DROPPED, list(TEXTS))
    assert q.classified(df, plan).first().row_class == "valid"
    out = q.typed(q.clean_cycles(df, plan), SCHEMA)
    assert out.columns == list(SCHEMA) and len(out.columns) == 109
    assert dict(out.dtypes)["Flow Duration"] == "bigint" and out.count() == 1


def test_repairs_and_drops(spark):
    line = flow_plan()
    assert q.classified(flow(spark, **{"Label": "SSH-Bruteforce"}), line).first().row_class == "dropped"
    assert "SSH-BruteForce" in VALID_LABELS
    assert q.clean_cycles(flow(spark, **{"Flow Duration": 0.0}), line).count() == 0
    fixed = q.clean_cycles(flow(spark, **{"TCP Window Fwd Mean": -100.0, "Payload Min": -1.0}), line).first()
    assert fixed["TCP Window Fwd Mean"] == 65436 and fixed["Payload Min"] == 0
    wrong = flow(spark, **{"Flow Bytes/s": 99.0})
    assert q.repair(wrong, flow_plan("expression")).first()["Flow Bytes/s"] == 2.0
    assert q.repair(wrong, line).first()["Flow Bytes/s"] == 99.0  # a tolerance rule read line by line accepts it

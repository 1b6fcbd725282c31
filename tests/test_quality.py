import math

import pytest
from pyspark.sql import functions as F

from netquarry.operators import quality as q

NAN, INF = math.nan, math.inf


def flags(spark, kind, check, values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(q.schema_flags(df, {"x": check})["x"]).collect()]


def test_numeric_checks(spark):
    assert flags(spark, "double", q.Numeric(), [1.0, NAN, -1.0, INF, None]) == [False, True, True, True, True]
    assert flags(spark, "bigint", q.Numeric(integer=True, allow_nan=False), [1, None, -1]) == [False, True, True]
    assert flags(spark, "bigint", q.Numeric(integer=True), [None]) == [False]
    tcp = q.Numeric(allow_negative=True, maximum=65535, sentinel=(-1,))
    assert flags(spark, "double", tcp, [-1.0, -2.0, 70000.0, 5.0]) == [False, True, True, False]


def test_text_checks(spark):
    assert flags(spark, "string", q.TIMESTAMP_TEXT, ["2018-02-14 01:02:03.5", "2018-02-14 01:02:03", "14/02/2018", None])[1:] == [False, True, True]
    assert flags(spark, "string", q.Text(allow_nan=False), ["", None]) == [False, True]


PLAN = q.Plan(
    schema={"win": q.Numeric(allow_negative=True, maximum=65535, sentinel=(-1,)), "n": q.Numeric(integer=True, allow_nan=False)},
    rules=(
        q.Rule("R025", "win == -1 OR win >= 0", target="win"),
        q.Rule("G001", "win != -1", target="win", applies="proto != 6\nOR\nn == 0"),
    ),
    formulas={"win": "win + 65536"},
    repairable_rules=frozenset({"R025"}),
    non_repairable=frozenset({"n"}),
)


def test_repair_and_sentinels(spark):
    rows = [(-100.0, 2, 6), (-1.0, 2, 6), (-1.0, 0, 6), (7.0, 0, 6), (9.0, 3, 6), (-5.0, None, 6)]
    df = spark.createDataFrame(rows, "win double, n bigint, proto bigint")
    assert [r.row_class for r in q.classified(df, PLAN).collect()] == ["repairable", "dropped", "valid", "dropped", "valid", "dropped"]
    assert sorted(r.win for r in q.clean_cycles(df, PLAN).collect()) == [-1.0, 9.0, 65436.0]
    counts = {(r.kind, r.name): r["count"] for r in q.quality_metrics(df, PLAN).collect()}
    assert counts[("rule", "G001")] == 2 and counts[("row", "repairable")] == 1 and counts[("missing", "n")] == 1


def test_repair_plan_has_no_shuffle_or_python(spark):
    df = spark.range(10).selectExpr("cast(id as double) win", "id n", "id proto")
    plan = q.clean_cycles(df, PLAN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_cleanup(spark):
    df = spark.createDataFrame([("1", "x"), ("1", "x"), ("a", "b"), (None, "y"), ("oops", "z")], " a string, `b ` string".replace(" a", "`a `"))
    out = q.initial_cleanup(df, strings=["b"])
    assert out.columns == ["a", "b"] and sorted(map(str, out.collect())) == sorted(["Row(a=1.0, b='x')", "Row(a=None, b='y')", "Row(a=None, b='z')"])
    with pytest.raises(ValueError, match="missing"):
        q.initial_cleanup(df, drop=["c"])


def test_safe_integer_and_types(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert [r[0] for r in q.typed(df, {"x": q.Numeric(integer=True)}).collect()] == [1, None]
    with pytest.raises(Exception, match="fraction"):
        q.typed(df.withColumn("x", F.lit(1.5)), {"x": q.Numeric(integer=True)}).collect()
    with pytest.raises(ValueError, match="missing"):
        q.typed(df, {"y": q.Numeric()})


def test_each_check_of_the_metrics_is_made_once(spark):
    from netquarry.plans import config, job_queries

    plan = config.plan_from(config.parse_config(job_queries.CLEAN))
    df = spark.range(4).selectExpr(
        "id l_orderkey", "1L l_linenumber", "cast(id + 1 as double) l_quantity", "5000d l_extendedprice", "0.05d l_discount", "-1d l_tax", "1d rate",
        "if(id = 3, 'none', '2020-01-01 00:00:00') stamp", "'A' l_returnflag",
    )
    made = q.quality_metrics(df, plan)
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("yyyy-MM-dd HH:mm:ss.SSSSSS") == 1
    assert {(r.kind, r.name): r["count"] for r in made.collect() if r["count"]} == {("text", "stamp"): 1, ("rule", "rate"): 4, ("row", "dropped"): 1, ("row", "repairable"): 3}

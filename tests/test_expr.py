import math

import pytest
from pyspark.sql import functions as F

from netquarry.functions.expr import compile_expr, parse, tokens

TYPES = {"a": "double", "b": "double", "n": "bigint", "Flow Bytes/s": "double", "s": "string"}


def value(spark, text, scope="line", constants=None, **row):
    schema = ", ".join(f"`{k}` {t}" for k, t in TYPES.items())
    df = spark.createDataFrame([tuple(row.get(k.replace(" ", "_").replace("/", "_")) for k in TYPES)], schema)
    return df.select(compile_expr(text, TYPES, constants, scope).alias("x")).first().x


def test_tokens_join_words_and_pad_parentheses():
    assert [t[1] for t in tokens("(Flow Bytes/s + 1)*2".replace("*", " * "))] == ["(", "Flow Bytes/s", "+", 1.0, ")", "*", 2.0]


def test_strength_and_associativity(spark):
    assert value(spark, "2 + 3 * 2 ** 3 ** 0") == 8
    assert value(spark, "10 - 4 - 3") == 3
    assert value(spark, "1 > 2 and 1 > 2 or 1 < 2") is True
    assert value(spark, "-7 % 3") == 2


def test_division_and_nan(spark):
    assert value(spark, "a / b", a=1.0, b=0.0) == math.inf and value(spark, "a / b", a=-1.0, b=0.0) == -math.inf
    assert math.isnan(value(spark, "a / b", a=0.0, b=0.0))
    assert value(spark, "a <= b", a=math.nan, b=1.0) is False and value(spark, "a != a", a=math.nan) is True
    assert value(spark, "a == a", a=math.nan) is False
    assert value(spark, "n <= 3") is None


@pytest.mark.parametrize(("expected", "actual", "line", "whole"), [(0.3, 0.3, False, True), (5.0, 99.0, True, False)])
def test_chain_scope(spark, expected, actual, line, whole):
    text = "a - 0.000001\n<=\nb\n<=\na + 0.000001"
    assert value(spark, text, "line", a=expected, b=actual) is line
    assert value(spark, text, "expression", a=expected, b=actual) is whole


def test_chain_on_one_line(spark):
    assert value(spark, "0 <= n <= 65535", n=70000) is False and value(spark, "0 <= n <= 65535", n=80) is True
    assert value(spark, "1 < 2 < 3 < 2") is False


def test_membership_constants_and_extensions(spark):
    assert value(spark, "s in SET", constants={"SET": ["x"]}, s="x") is True
    assert value(spark, "s NOTIN SET", constants={"SET": ["x"]}) is True
    assert value(spark, "s == kind", constants={"kind": "x"}, s="x") is True
    assert value(spark, "NOT n == 1 AND TRUE", n=2) is True


def test_malformed_and_unknown(spark):
    for text in ("a +", "( a", "a b + + c )", ""):
        with pytest.raises(ValueError):
            parse(text)
    with pytest.raises(ValueError, match="missing"):
        compile_expr("missing > 1", TYPES)
    with pytest.raises(ValueError):
        compile_expr("s IN a", TYPES)
    assert parse("a + 1") is parse("a + 1")
    assert isinstance(compile_expr("a", {}, columns={"a": F.lit(1)}), type(F.lit(1)))

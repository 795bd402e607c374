"""Two-valued conditions on single rows."""

import datetime
import math

import pytest
from pyspark.sql import types as T

from entigraph.operators.filters import condition, like_pattern
from entigraph.plans import ir

SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("t", T.TimestampNTZType()),
        T.StructField("n", T.StringType()),
        T.StructField("nan", T.DoubleType()),
        T.StructField("a", T.ArrayType(T.IntegerType())),
    ]
)
ROW = (5, 2.5, "a%b_c\\d", True, datetime.datetime(2020, 1, 2), None, math.nan, [1])


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([ROW], SCHEMA).cache()


CASES = [
    (ir.eq("i", 5), True), (ir.eq("i", 5.0), True), (ir.eq("i", "5"), False), (ir.ne("i", "5"), True), (ir.eq("n", None), True), (ir.eq("i", None), False),
    (ir.ne("n", "x"), True), (ir.eq("n", "x"), False), (ir.lt("n", "x"), False), (ir.ge("i", 5), True), (ir.gt("i", 5), False), (ir.le("d", 2.5), True),
    (ir.lt("b", True), False), (ir.eq("b", True), True), (ir.eq("b", 1), False), (ir.gt("t", datetime.datetime(2020, 1, 1)), True), (ir.lt("i", "x"), False),
    (ir.eq("nan", math.nan), False), (ir.gt("nan", 1.0), False), (ir.ne("nan", 1.0), True), (ir.eq("a", [1]), False),
    (ir.In("i", (1, 5)), True), (ir.In("i", ()), False), (ir.In("i", (), True), True), (ir.In("n", ("x",)), False), (ir.In("n", ("x", None)), True), (ir.In("n", ("x",), True), True), (ir.In("i", ("5",)), False),
    (ir.Null("n"), True), (ir.Null("n", True), False), (ir.Null("i"), False),
    (ir.Like("s", "a%"), True), (ir.Like("s", r"a\%b\_c\\d"), True), (ir.Like("s", r"a\%x%"), False), (ir.Like("s", "%\\"), False), (ir.Like("n", "%"), False), (ir.Like("n", "%", True), True),
    (ir.Like("i", "5"), False), (ir.Like("i", "5", True), True), (ir.Like("s", "A%"), False), (ir.Like("s", "A%", ignore_case=True), True), (ir.Like("s", r"\a%"), True),
    (ir.And(), True), (ir.Or(), False), (ir.And((ir.eq("i", 5), ir.Or((ir.eq("i", 1), ir.Null("n"))))), True), (ir.Not(ir.eq("n", "x")), True), (ir.Not(ir.Not(ir.eq("n", "x"))), False), (ir.Not(ir.Or((ir.lt("n", "x"), ir.eq("i", 5)))), False),
    (ir.contains("s", "%b_"), True), (ir.contains("s", "xb"), False), (ir.starts_with("s", "a%"), True), (ir.ends_with("s", "\\d"), True), (ir.between("i", 5, 6), True),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(row, k):
    what, holds = CASES[k]
    assert row.where(condition(what, SCHEMA)).count() == int(holds), what


def test_negation_is_complement(row):
    parts = [condition(ir.Not(what), SCHEMA).cast("int").alias(f"c{k}") for k, (what, _) in enumerate(CASES)]
    assert list(row.select(*parts).first()) == [int(not holds) for _, holds in CASES]


def test_refusals():
    with pytest.raises(ValueError, match="unknown field"):
        condition(ir.eq("zz", 1), SCHEMA)
    with pytest.raises(ValueError, match="nested"):
        condition(ir.And((ir.Or(),)), SCHEMA, strict=True)
    with pytest.raises(ValueError, match="ranks rows"):
        condition(ir.Or((ir.TextMatch("s", "x"),)), SCHEMA)


def test_like_pattern():
    assert like_pattern(r"a\b\%") == "ab\\%"
    assert like_pattern("x\\") is None

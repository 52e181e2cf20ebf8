import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions.numeric import as_double, column, finite_or_null
from skyloom.functions.score import score_columns, score_expression
from skyloom.operators.clean import needs_ra_shift, normalise_positions, position_extrema
from skyloom.operators.report import column_report, sampled_column_report


@pytest.mark.parametrize("ra, shift", [((-10, 170), True), ((0, 360), False), ((-1e-7, 10), False)])
def test_ra_ranges(ra, shift):
    assert needs_ra_shift(*ra, -90, 90) is shift


@pytest.mark.parametrize("extrema", [(-10, 200, 0, 1), (0, 1, 0, 91), (0, float("inf"), 0, 1), (None, None, None, None)])
def test_bad_ranges(extrema):
    with pytest.raises(ValueError):
        needs_ra_shift(*extrema)


def test_normalise(spark):
    df = spark.createDataFrame([("-10", 1.0), ("170", 2.0)], "ra string, dec double")
    assert sorted(r["ra"] for r in normalise_positions(df, "ra", "dec").collect()) == [170.0, 350.0]
    assert normalise_positions(df.limit(0), "ra", "dec").count() == 0
    with pytest.raises(ValueError, match="1 rows"):
        normalise_positions(df.union(spark.createDataFrame([("x", 1.0)], df.schema)), "ra", "dec")
    nan = spark.createDataFrame([(float("nan"), 1.0), (5.0, None), (7.0, 2.0)], "ra double, dec double")
    assert tuple(position_extrema(nan, "ra", "dec").first()) == (5.0, 7.0, 1.0, 2.0, 2)


def test_coercion(spark):
    df = spark.createDataFrame([("1.5", True, 3), ("x", False, None), (None, None, 4)], "s string, b boolean, `odd``name` int")
    got = df.select(as_double(df, "s"), as_double(df, "b"), as_double(df, "odd`name")).collect()
    assert [tuple(r) for r in got] == [(1.5, 1.0, 3.0), (None, 0.0, None), (None, None, 4.0)]
    assert df.select(column("odd`name")).columns == ["odd`name"]
    f = spark.createDataFrame([(x,) for x in (1.0, float("nan"), float("inf"), None)], "x double")
    assert [r[0] for r in f.select(finite_or_null(F.col("x"))).collect()] == [1.0, None, None, None]


@pytest.mark.parametrize(
    "text, value",
    [("a + b * 2", 7.0), ("-a ** 2", -1.0), ("np.sqrt(b + 1)", 2.0), ("np.log10(a * 100)", 2.0), ("a / (b - 3)", None), ("np.log(a - 1)", None), ("np.where(a < b, 10, 20)", 10.0), ("b % 2 + b // 2", 2.0), ("np.maximum(a, b) + np.pi * 0", 3.0), ("abs(a - b)", 2.0), ("b", 3.0)],
)
def test_score_expressions(spark, text, value):
    df = spark.createDataFrame([(1.0, 3)], "a double, b int")
    got = df.select(score_expression(text, lambda c: as_double(df, c), df.columns)).first()[0]
    assert got is None if value is None else math.isclose(got, value)


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "c + 1", "open(a)", "a +", "[a]", "lambda: a", "'a'", "a if b else a"])
def test_refused_expressions(spark, text):
    df = spark.createDataFrame([(1.0, 3)], "a double, b int")
    with pytest.raises(ValueError):
        score_expression(text, lambda c: as_double(df, c), df.columns)


def test_score_columns():
    assert score_columns("np.log(b) + a", ["x", "a", "b"]) == ["a", "b"]
    assert score_columns("odd name", ["odd name", "odd"]) == ["odd name"]


def test_reports(spark):
    df = spark.createDataFrame([(1, float("nan"), None, [1]), (None, 4.0, "x", None), (3, 6.0, None, None)], "i int, d double, s string, a array<int>")
    got = {r["column"]: tuple(r)[1:] for r in column_report(df).collect()}
    assert got == {"i": ("int", 1, 1.0, 3.0, 2.0, None), "d": ("double", 1, 4.0, 6.0, 5.0, None), "s": ("string", 2, None, None, None, "x"), "a": ("array<int>", 2, None, None, None, "[1]")}
    assert column_report(df.limit(0)).count() == 4
    assert sampled_column_report(df, 2).count() == 4


def test_whole_report_covers_every_column(spark):
    from skyloom.plans.registry import column_reports_whole

    folder = "/root/testdata/sf0.001"
    names = spark.read.parquet(f"{folder}/dp1_objects.parquet").columns
    got = {r["column"]: r for r in column_reports_whole(spark, folder).collect()}
    assert sorted(got) == sorted(names)
    assert {c for c in got if got[c]["shown"]} == {c for c in got if got[c]["type"] in ("boolean", "timestamp")}


def test_no_mean_of_both_infinities(spark):
    df = spark.createDataFrame([(float("inf"), float("inf")), (float("-inf"), 1.0), (1.0, float("nan"))], "a double, b double")
    assert [r["mean"] for r in column_report(df).collect()] == [None, float("inf")]

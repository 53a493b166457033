"""Bisection is exact for any distribution; combined days keep their error bound."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import percentiles as pc


def smallest(values, share):
    values = sorted(values)
    return values[max(1, math.ceil(share * len(values) - 1e-9)) - 1]


@pytest.mark.parametrize(
    "values",
    [[0.0, 5e-324], [5e-324, 1e-323, 1.5e-323], [1.0] * 50 + [2.0], [float("inf"), -float("inf"), 0.0, 1.0], [-3.0, -2.0, -1e-300, 1e300], [10.0**k for k in range(-300, 300, 7)], [1 + k * 2.0**-52 for k in range(100)], [3.0]],
)
def test_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = pc.bisect(df, [], "v", [0.01, 0.5, 0.99], parts=4).collect()
    assert {r["share"]: r["v"] for r in got} == {s: smallest(values, s) for s in (0.01, 0.5, 0.99)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
def test_any_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert pc.bisect(df, [], "v", [0.5]).first()["v"] == smallest(values, 0.5)


def attempts(spark, rows):
    return spark.createDataFrame(rows, "attempt_id bigint, reader_type string, duration_s double, run_day string, share double")


def test_odd_rows(spark):
    rows = [(1, " A", 1.0, "x", 0.0), (1, " A", 1.0, "x", 0.0), (2, "a", 0.0, None, 0.0), (3, "a", None, "x", 0.0), (4, "a", float("nan"), "x", 0.0), (5, "a", -1.0, "x", 0.0), (6, None, 1.0, "x", 0.0), (7, " ", 1.0, "x", 0.0), (8, "a", 9.0, "y", 0.0)]
    got = pc.reader_percentiles(attempts(spark, rows), [0.5]).collect()
    assert [(r["reader_type"], r["n"], r["duration_s"]) for r in got] == [("a", 3, 1.0)]
    for empty in (pc.reader_percentiles, pc.outliers, lambda a: pc.combine(pc.day_summaries(a))):
        assert empty(attempts(spark, [])).count() == 0


def test_days_combine_within_the_bound(spark):
    df = spark.range(20_000).select(F.col("id").alias("attempt_id"), F.lit("a").alias("reader_type"), F.exp(F.randn(3) * 2).alias("duration_s"), (F.col("id") % 200).cast("string").alias("run_day")).cache()
    summaries = pc.day_summaries(df)
    apart = pc.day_summaries(df.where("attempt_id < 9000")).unionByName(pc.day_summaries(df.where("attempt_id >= 9000")))
    exact = {r["share"]: r["duration_s"] for r in pc.reader_percentiles(df).collect()}
    for s in (summaries, apart):
        for r in pc.combine(s).collect():
            assert r["least"] <= exact[r["share"]] <= r["most"] <= r["least"] * (1 + 1 / pc.STEPS)


def test_outliers(spark):
    rows = [(i, "a", 1.0, "x", 0.0) for i in range(200)] + [(500, "a", 5.0, "x", 0.0), (501, "a", 5.1, "x", 0.0)]
    assert [r[0] for r in pc.outliers(attempts(spark, rows)).collect()] == [501]

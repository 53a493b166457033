"""Tree aggregation equals GROUP BY, in as many rounds as the fan-in asks for."""

from pyspark.sql import functions as F

from tilewright.operators import skew


def test_equals_group_by_over_three_rounds(spark):
    df = spark.range(0, 5000, numPartitions=200).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("k"), "id")
    got = skew.tree_aggregate(df, ["k"], {"n": ("count", F.col("id")), "s": ("sum", F.col("id")), "a": ("min", F.col("id")), "b": ("max", F.col("id"))}, fan_in=6, chunks=200)
    want = df.groupBy("k").agg(F.count("id").alias("n"), F.sum("id").alias("s"), F.min("id").alias("a"), F.max("id").alias("b"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # 200 chunks, 34, 6, 1


def coords(spark, rows):
    return spark.createDataFrame(rows, "patch_id bigint, name string, id string, coords array<bigint>, n_patches int")


def test_extents_of_odd_rows(spark):
    rows = [(1, " A ", "i", [1, 2], 0), (1, " A ", "i", [1, 2], 0), (2, "a", "i", [5, 0], 0), (3, "a", "i", None, 0), (4, "a", "i", [1, None], 0), (5, "a", "i", [-1, 3], 0), (6, None, "i", [7, 7], 0), (None, "a", "i", [9, 9], 0), (7, "b", None, [], 0)]
    got = {(r["name"], r["id"]): tuple(r)[2:] for r in skew.slide_extents(coords(spark, rows)).collect()}
    assert got == {("a", "i"): (5, 2, 1, 0, 5, 2), (None, "i"): (1, 1, 7, 7, 7, 7), ("b", None): (1, 0, None, None, None, None)}
    assert skew.slide_extents(coords(spark, [])).count() == 0


def test_heavy_names(spark):
    rows = [(i, "hot" if i % 2 else None, "i", [0, 0], 0) for i in range(300)] + [(1000, "rare", "i", [0, 0], 0)]
    assert [r["name"] for r in skew.heavy_names(coords(spark, rows)).collect()] == ["hot"]
    assert skew.heavy_names(coords(spark, [])).count() == 0

"""A ledger neither skips nor repeats a record, whatever fails; fragmented ledgers stay cheap."""

import time

import pytest
from pyspark.sql import functions as F

from tilewright.operators import incremental as inc

STATE = "id bigint, n bigint"


def ledger(spark, path):
    return inc.Ledger(spark, f"file://{path}", STATE, lambda df: df.groupBy("id").agg(F.sum("n").alias("n")))


def source(rows):
    return {"s": inc.Source(rows, "seq", lambda df: df.groupBy(F.pmod("seq", F.lit(3)).alias("id")).agg(F.count("*").alias("n")))}


def rows(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "seq bigint")


def counted(led):
    return sum(r["n"] for r in led.state().collect())


def test_late_rows_and_reruns(spark, tmp_path):
    led = ledger(spark, tmp_path)
    led.run(source(rows(spark, [1, 2, 5, 70_000])))
    led.run(source(rows(spark, [1, 2, 3, 5, 70_000, 70_001, -4])))
    led.run(source(rows(spark, [1, 2, 3, 5, 70_000, 70_001, -4])))
    assert counted(led) == 7
    assert sorted((r["lo"], r["hi"]) for r in inc.maximal(led.processed()).collect()) == [(-4, -4), (1, 3), (5, 5), (70_000, 70_001)]


def test_failures_leave_no_trace(spark, tmp_path):
    led = ledger(spark, tmp_path)
    led.run(source(rows(spark, range(10))))

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        led.run(source(rows(spark, range(20))), before_commit=fail)
    bad = source(rows(spark, range(20)))
    bad["s"].delta = lambda df: df.select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="broken"):
        led.run(bad)
    assert led.version() == 1 and counted(led) == 10
    led.run(source(rows(spark, range(25))))
    assert led.version() == 2 and counted(led) == 25


def test_rival_runs_commit_once(spark, tmp_path):
    one, two = ledger(spark, tmp_path), ledger(spark, tmp_path)
    with pytest.raises(RuntimeError, match="another run"):
        one.run(source(rows(spark, range(5))), before_commit=lambda: two.run(source(rows(spark, range(5)))))
    assert counted(one) == 5


def test_changes_are_folded_after_some_runs(spark, tmp_path):
    led = ledger(spark, tmp_path)
    for k in range(1, inc.KEPT + 3):
        led.run(source(rows(spark, range(k))))
    assert counted(led) == inc.KEPT + 2 and len(led._marker(led.version())["parts"]) <= inc.KEPT


def test_intervals_across_blocks_and_repeats(spark):
    df = rows(spark, [*range(65_500, 65_600), 65_510, None]).select(F.lit("s").alias("source"), "seq")
    assert [(r["lo"], r["hi"]) for r in inc.maximal(inc.intervals(df)).collect()] == [(65_500, 65_599)]


def test_subtracted():
    assert inc.subtracted((0, 9), [(2, 3), (5, 5), (9, 20)]) == [(0, 1), (4, 4), (6, 8)]
    assert inc.subtracted((0, 9), []) == [(0, 9)] and inc.subtracted((3, 4), [(0, 9)]) == []


def test_fragmented_ledger(spark):
    n = 400_000
    even = spark.range(0, n, 2).select(F.lit("s").alias("source"), F.col("id").alias("seq"))
    done = inc.intervals(even).cache()
    done.count()
    df = spark.range(n + 70_000).select(F.col("id").alias("seq"), F.lit(1).alias("block"), F.lit("x").alias("runs"))
    began = time.time()
    got = inc.unprocessed(df, "s", "seq", done)
    assert got.columns == df.columns and got.where("seq % 2 = 1 OR seq >= 400000").count() == got.count() == n // 2 + 70_000
    assert time.time() - began < 20
    wide = inc.intervals(spark.range(0, 6400).where("id % 640 <> 5 OR id > 6000").union(spark.range(10_000, 20_000, 100)).select(F.lit("s").alias("source"), F.col("id").alias("seq")))
    left = {r["seq"] for r in inc.unprocessed(spark.range(21_000).select(F.col("id").alias("seq")), "s", "seq", wide).collect()}
    seen = {i for i in range(6400) if i % 640 != 5 or i > 6000} | set(range(10_000, 20_000, 100))
    assert left == set(range(21_000)) - seen


def test_empty_and_null_numbers(spark, tmp_path):
    led = ledger(spark, tmp_path)
    led.run(source(rows(spark, [])))
    led.run(source(rows(spark, [None, 4])))
    assert counted(led) == 1


def test_pending(spark, tmp_path):
    t = "timestamp_ntz'2025-01-0%d 00:00:00'"
    slides = spark.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"({i}L, {s}, {c}, {t % d})" for i, s, c, d in [(1, "'a'", "'x'", 1), (1, "'a'", "'x'", 1), (2, "'a'", "'y'", 2), (3, "'b'", "'x'", 1), (4, "'b'", "NULL", 3), (5, "'c'", "NULL", 1), (6, "NULL", "'x'", 1), (7, "'d'", "'q'", 1)])
        + " AS t(listing_id, id, checksum, listed_at)"
    )
    events = spark.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"({i}L, {s}, 'segmentation', {st}, {c}, {t % d})" for i, s, st, c, d in [(1, "'a'", "'completed'", "'x'", 3), (2, "'b'", "' Completed '", "'x'", 3), (3, "'d'", "'error'", "'q'", 3), (4, "'d'", "NULL", "'q'", 4)])
        + " AS t(event_id, id, task, status, checksum, ts)"
    )
    led = inc.slide_ledger(spark, f"file://{tmp_path}")
    led.run(inc.slide_sources(slides, events))
    assert sorted(r["id"] for r in inc.pending(led).collect()) == ["a", "d"]

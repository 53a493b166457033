"""entry() runs and its query keeps the patches that FIXTURES.md counts."""

from pyspark.sql import functions as F

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_counts(spark):
    counts = __spark_entry__.queries()["tissue_patch_counts"](spark, "/root/testdata/sf0.01")
    assert counts.agg(F.sum("n_patches")).first()[0] == 11568
    assert __spark_entry__.queries()["grid_coords"](spark, "/root/testdata/sf0.01").count() == 33863

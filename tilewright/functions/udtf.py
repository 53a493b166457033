"""Table functions for SQL: SELECT ... FROM slides, LATERAL patch_grid(w, h, ps, step)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="patch_idx bigint, x bigint, y bigint")
class PatchGrid:
    """The patches of one slide, row by row. For whole tables grid.patches() is faster, since it
    never leaves the JVM."""

    def eval(self, w: int, h: int, ps: int, step: int) -> Iterator[tuple]:
        if None in (w, h, ps, step) or ps <= 0:
            return
        if step <= 0:
            raise ValueError("step must be positive")
        n = 0
        for y in range(0, h, step):
            for x in range(0, w, step):
                yield n, x, y
                n += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("patch_grid", PatchGrid)

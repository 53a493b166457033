"""The pipeline of stages: slides -> patches on tissue -> patch features -> slide features.

Every stage is a table in the job's folder, partitioned by bucket of the slide, with an outcome
per slide in `outcomes`; a stage processes the slides that have none yet (an anti-join), so a
run that is repeated does nothing twice. Slides without a patch have an outcome too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import written
from tilewright.operators import encoders, grid, log, polygons, pooling


@dataclass
class Job:
    """folder: where the tables of the stages are. slides: (sid, w, h, mpp). tissue: (sid,
    tissue_id, rings). tiles: from patches (sid, patch_idx, x, y, ps) to the same with (h, w,
    pixels); it is only asked for patches on tissue."""

    spark: SparkSession
    folder: str
    slides: DataFrame
    tissue: DataFrame
    tiles: Callable[[DataFrame], DataFrame]
    patch_size: int = 256
    target: int = 20
    overlap: int = 0
    threshold: float = 0.15
    encoder: encoders.Encoder = field(default_factory=encoders.mean_rgb)

    def _path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def _there(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        if not self._there(table):
            return self.spark.createDataFrame([], schema or "sid string")
        return self.spark.read.parquet(self._path(table))

    def outcomes(self) -> DataFrame:
        """(sid, task, status, reason, n)"""
        return self.read("outcomes", "sid string, task string, status string, reason string, n bigint")

    def _todo(self, task: str) -> DataFrame:
        done = self.outcomes().where(F.col("task") == task).select("sid", "task")
        return log.left_to_do(self.slides.select(F.col("sid").cast("string")), [task], done, ["sid"])

    def _finish(self, task: str, todo: DataFrame, rows: DataFrame, reason: str) -> None:
        """Rows first, then the outcomes that make them count: what a failed run left is dropped
        when the slides' rows are read (rows())."""
        counts = rows.groupBy("sid").agg(F.count("*").alias("n"))
        out = todo.join(counts, "sid", "left").select("sid", F.lit(task).alias("task"), F.lit("completed").alias("status"), F.when(F.col("n").isNull(), reason).alias("reason"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        out.write.mode("append").parquet(self._path("outcomes"))

    def _append(self, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = written(rows, table)
        rows.write.mode("append").parquet(self._path(table))
        return rows.select(*keys)

    def coords(self) -> DataFrame:
        """(sid, patch_idx, x, y, ps, step) of patches on tissue."""
        todo = written(self._todo("coords"), "todo")
        slides = self.slides.withColumn("sid", F.col("sid").cast("string")).join(todo, "sid", "left_semi")
        every = grid.patches(slides, self.patch_size, self.target, self.overlap)
        placed = grid.scan_order(polygons.on_polygons(every, self.tissue.withColumn("sid", F.col("sid").cast("string")), self.threshold))
        self._finish("coords", todo, self._append("coords", placed.select("sid", "patch_idx", "x", "y", "ps", "step"), ["sid"]), "no patch on tissue")
        return self.rows("coords", ["sid", "patch_idx"], "sid string, patch_idx bigint, x bigint, y bigint, ps bigint, step bigint")

    def rows(self, table: str, keys: list[str], schema: str) -> DataFrame:
        """Rows of the slides that have an outcome of the stage, repeats of failed runs dropped."""
        ready = self.outcomes().where(F.col("task") == table).select("sid")
        return self.read(table, schema).dropDuplicates(keys).join(ready, "sid", "left_semi")

    def patch_features(self) -> DataFrame:
        """(sid, patch_idx, features), of the stage coords, which is run before."""
        patches = self.coords()
        task = f"patch_features:{self.encoder.name}"
        todo = written(self._todo(task), "todo")
        tiles = self.tiles(patches.join(todo, "sid", "left_semi"))
        made = encoders.encoded(tiles, self.encoder, ["sid", "patch_idx"])
        self._finish(task, todo, self._append(task.replace(":", "_"), made, ["sid"]), "no patch on tissue")
        ready = self.outcomes().where(F.col("task") == task).select("sid")
        return self.read(task.replace(":", "_"), "sid string, patch_idx bigint, features array<double>").dropDuplicates(["sid", "patch_idx"]).join(ready, "sid", "left_semi")

    def slide_features(self) -> DataFrame:
        """(sid, n, features): the mean of a slide's patch features, null for slides without any."""
        means = pooling.mean_vectors(self.patch_features(), ["sid"], self.encoder.dim)
        return self.slides.select(F.col("sid").cast("string")).distinct().join(means, "sid", "left").select("sid", F.coalesce("n", F.lit(0)).alias("n"), "features")

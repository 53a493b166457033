"""Queries on masks, histograms and tiles, on the encoders, the pipeline and the file stream, and
their SQL. Tiles are drawn (sources.tiles), since the driver's tables have no pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import scratch, table
from tilewright.functions import geometry
from tilewright.operators import encoders, pooling, raster
from tilewright.plans.pipeline import Job
from tilewright.sources import tiles
from tilewright.streaming.ingest import ingest


def otsu_hist(spark: SparkSession, d: str) -> DataFrame:
    return raster.otsu(table(spark, d, "events"), "event_type", "value").withColumn("threshold", F.round("threshold", 6))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS sid", "l_partkey % 40 - 2 AS x", "l_orderkey % 40 AS y", "CAST(l_linenumber AS BIGINT) AS side", "CAST(l_quantity % 3 AS INT) AS label")


def mask_accumulate(spark: SparkSession, d: str) -> DataFrame:
    cells = raster.accumulated(_tiles(spark, d), 42, 42)
    return cells.select("sid", "mx", "my", "hits", "label", raster.binarised(F.col("hits")).alias("mask"))


def mask_pyramid(spark: SparkSession, d: str) -> DataFrame:
    cells = raster.accumulated(_tiles(spark, d)).select("sid", "mx", "my", F.col("hits").cast("double").alias("v"))
    return raster.pyramid(cells, 2).withColumn("v", F.round("v", 6))


def colour_blend(spark: SparkSession, d: str) -> DataFrame:
    ramp = [(i, 255 - i, 128) for i in range(256)]
    e = table(spark, d, "events").select("event_id", raster.coloured(F.col("value") / 20, ramp).alias("c"), (F.col("event_id") % 256).cast("double").alias("v"))
    return e.select("event_id", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.round(raster.blended(F.col("c.r"), F.col("v")), 6).alias("blend"), F.round(raster.grey(F.col("c.r"), F.col("c.g"), F.col("c.b")), 6).alias("grey"))


def _drawn(spark: SparkSession, pixels: bool = True) -> DataFrame:
    tiles.register(spark)
    return spark.read.format("tiles").option("slides", 4).option("side", 1024).option("size", 128).option("pixels", str(pixels).lower()).load()


def tile_encode(spark: SparkSession, d: str) -> DataFrame:
    return encoders.encoded(_drawn(spark), encoders.random_projection(16), ["sid", "x", "y"])


def tile_tissue(spark: SparkSession, d: str) -> DataFrame:
    return raster.segmented(_drawn(spark))


def mask_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Masks of slides from lineitem's tiles to polygons, with their net area."""
    masks = raster.drawn(raster.covered(_tiles(spark, d), 40, 40), 40, 40, 10.0)
    shapes = raster.mask_polygons(masks, most_holes=1600)  # all there can be
    holes = F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0)))
    return shapes.groupBy("sid").agg(F.sum(geometry.net_area(F.col("rings")[0], holes)).cast("long").alias("area"))


def encoder_registry(spark: SparkSession, d: str) -> DataFrame:
    return encoders.registry(spark)


def pipeline_slides(spark: SparkSession, d: str) -> DataFrame:
    """Slides to slide vectors through all stages, on drawn slides."""
    slides = _drawn(spark, pixels=False).groupBy("sid").agg(F.lit(1024).alias("w"), F.lit(1024).alias("h"), F.lit(0.5).alias("mpp"))
    box = F.array(geometry.rectangle(F.lit(200.0), F.lit(200.0), F.lit(824.0), F.lit(700.0)))
    tissue = slides.where("sid <> 'slide3'").select("sid", F.lit(0).alias("tissue_id"), box.alias("rings"))
    pixels = _drawn(spark)
    job = Job(spark, scratch(spark, "job"), slides, tissue, lambda p: p.join(pixels, ["sid", "x", "y"]), patch_size=128)
    return job.slide_features().select("sid", "n", F.posexplode_outer("features").alias("i", "v")).withColumn("v", F.round("v", 6))


def incremental_feat(spark: SparkSession, d: str) -> DataFrame:
    """The norms of all vectors, by a stream over the files; equal to those of the batch."""
    out = scratch(spark, "norms")
    rows = table(spark, d, "embeddings")
    query = ingest(spark, d, rows.schema, out, scratch(spark, "stream"), "vec_id", lambda r: r.select("vec_id", F.round(pooling.l2_norm(F.col("embedding")), 6).alias("norm")), names="embeddings.parquet")
    query.awaitTermination()
    return spark.read.schema("vec_id bigint, norm double").parquet(out)


QUERIES = {f.__name__: f for f in (otsu_hist, mask_accumulate, mask_pyramid, colour_blend, tile_encode, tile_tissue, mask_outlines, encoder_registry, pipeline_slides, incremental_feat)}

_CELLS = """WITH t AS (SELECT l_suppkey AS sid, l_partkey % 40 - 2 AS x, l_orderkey % 40 AS y, CAST(l_linenumber AS BIGINT) AS side, CAST(l_quantity % 3 AS INTEGER) AS label FROM lineitem),
a AS (SELECT sid, y, side, label, unnest(range(x, x + side)) AS mx FROM t), b AS (SELECT sid, mx, label, unnest(range(y, y + side)) AS my FROM a)
"""

SQL = {
    "otsu_hist": """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
b AS (SELECT event_type, lo, (hi - lo) / 256 AS w, least(255, CAST(floor((value - lo) / ((hi - lo) / 256)) AS INTEGER)) AS b, CAST(count(*) AS DOUBLE) AS c FROM events JOIN e USING (event_type) GROUP BY ALL),
m AS (SELECT event_type, b, lo + (b + 0.5) * w AS mid, sum(c) OVER r AS w1, sum(c * (lo + (b + 0.5) * w)) OVER r AS s1, sum(c) OVER (PARTITION BY event_type) AS w, sum(c * (lo + (b + 0.5) * w)) OVER (PARTITION BY event_type) AS s FROM b WINDOW r AS (PARTITION BY event_type ORDER BY b)),
v AS (SELECT *, coalesce(round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / nullif(w - w1, 0), 2), 6), -1) AS between FROM m)
SELECT event_type, round(arg_max(mid, (between, -b)), 6) AS threshold FROM v GROUP BY 1""",
    "mask_accumulate": _CELLS + "SELECT sid, mx, my, count(*) FILTER (WHERE label > 0) AS hits, max(label) AS label, CASE WHEN count(*) FILTER (WHERE label > 0) > 0 THEN 255 ELSE 0 END AS mask FROM b WHERE mx >= 0 AND mx < 42 AND my < 42 GROUP BY 1, 2, 3",
    "mask_pyramid": _CELLS + ", h AS (SELECT sid, mx, my, count(*) FILTER (WHERE label > 0) AS v FROM b WHERE mx >= 0 GROUP BY 1, 2, 3) SELECT sid, mx // 4 AS mx, my // 4 AS my, round(avg(v), 6) AS v FROM h GROUP BY 1, 2, 3",
    "colour_blend": """WITH e AS (SELECT event_id, CAST(least(255, greatest(0, floor(value / 20 * 256))) AS INTEGER) AS r FROM events WHERE value IS NOT NULL)
SELECT event_id, r, 255 - r AS g, round(r * 0.6::DOUBLE + event_id % 256 * 0.4::DOUBLE, 6) AS blend, round(0.2125::DOUBLE * r + 0.7154::DOUBLE * (255 - r) + 0.0721::DOUBLE * 128, 6) AS grey FROM e""",
    "mask_outlines": _CELLS + "SELECT CAST(sid AS VARCHAR) AS sid, CAST(100 * count(*) AS BIGINT) AS area FROM (SELECT DISTINCT sid, mx, my FROM b WHERE label > 0 AND mx >= 0 AND mx < 40 AND my < 40) GROUP BY 1",
    "incremental_feat": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings",
}

"""Queries on vectors, scores, ranks and heatmaps, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import table
from tilewright.operators import encoders, pooling, ranking

DIM = 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """One row per valid vector."""
    rows = table(spark, d, "patch_features").where("vec_id IS NOT NULL AND encoder IS NOT NULL AND id IS NOT NULL").select("vec_id", "patch_id", "id", "encoder", "coords", "features")
    return rows.where(pooling.valid(F.col("features"), DIM)).dropDuplicates(["vec_id"])


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))


def _rounded(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.round(name, 6))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pooling.mean_pool(_vectors(spark, d), ["encoder", "id"]), "mean")


def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    """mean_pool() by arrays, as a row per dimension."""
    pooled = pooling.mean_vectors(_vectors(spark, d), ["encoder", "id"], DIM)
    return _rounded(pooling.rows_of(pooled, ["encoder", "id"]).withColumnRenamed("v", "mean"), "mean")


def concat_pool(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pooling.concat_pool(_embeddings(spark, d), ["label"], "vec_id"), "v")


def softmax_pool(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pooling.softmax_pool(_embeddings(spark, d).withColumn("score", (F.col("vec_id") % 17) / 4.0), ["label"], "score"), "v")


def abmil_pool(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pooling.attention_pool(_vectors(spark, d), ["encoder", "id"], pooling.Attention(DIM)), "v")


def late_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the vectors of a patient's slides, each the mean of its patches."""
    slides = pooling.mean_vectors(_embeddings(spark, d), ["label"], DIM)
    return _rounded(pooling.mean_pool(slides.withColumn("patient", F.col("label") % 3), ["patient"]), "mean")


def cls_mean_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as eight tokens of eight numbers: the first, and the mean of those after the second."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("features").cast("array<double>"), i * 8 + 1, 8))
    return _rounded(pooling.rows_of(_embeddings(spark, d).withColumn("features", encoders.cls_and_mean(tokens, 2)), ["vec_id"]), "v")


def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.round(pooling.l2_norm(F.col("features")), 6).alias("norm"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest vectors of other slides for every vector whose id is divisible by 100."""
    rows = _vectors(spark, d).select("vec_id", F.concat_ws("|", "encoder", "id").alias("part"), "features")
    return pooling.cosine_topk(rows, rows.where("vec_id % 100 = 0"), 5, DIM, apart=True)


def rank_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return ranking.rank_normalised(rows, "event_type", "value").select("event_id", F.round("rank", 9).alias("rank"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """One row per located patch, with a score."""
    rows = table(spark, d, "patch_coords").where("patch_id IS NOT NULL AND id IS NOT NULL").select("patch_id", "id", "coords", "patch_size_level0").dropDuplicates(["patch_id"])
    x, y = F.get("coords", F.lit(0)), F.get("coords", F.lit(1))
    good = (F.size("coords") == 2) & (x >= 0) & (y >= 0)
    return rows.where(good).select("patch_id", F.col("id").alias("sid"), x.alias("x"), y.alias("y"), F.col("patch_size_level0").alias("ps"), (F.col("patch_id") * 37 % 101 / 100.0).alias("score"))


def heatmap_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.heatmap(_scored(spark, d), 1 / 512), "score")


def topk_patches(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_patches(_scored(spark, d), "sid", "score", "patch_id", 3).select("sid", "patch_id", "score", "rank_desc", "file_no")


def shard_batches(spark: SparkSession, d: str) -> DataFrame:
    return ranking.shards(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7, 64)


def auc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_type", "value / 20 AS score", "CAST(event_id % 3 = 0 AS INT) AS label")
    return ranking.auc(rows, "event_type", "score", "label").select("event_type", "n", F.round("auc", 9).alias("auc"), F.round("accuracy", 9).alias("accuracy"))


_CENTRES = [[0.3 if i == j else 0.0 for i in range(DIM)] for j in range(4)]


def cluster_assign(spark: SparkSession, d: str) -> DataFrame:
    return ranking.nearest_centroid(_embeddings(spark, d), _CENTRES).select("vec_id", "cluster")


def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    return ranking.agreement(ranking.nearest_centroid(_embeddings(spark, d), _CENTRES), "label", "cluster").withColumn("ari", F.round("ari", 9))


def kmeans_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ranking.kmeans(_embeddings(spark, d), 10).groupBy("cluster").agg(F.count("*").alias("n"))


def projection(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.projected(_embeddings(spark, d))
    return rows.select("vec_id", F.col("projection")[0].alias("a"), F.col("projection")[1].alias("b"))


def subsample(spark: SparkSession, d: str) -> DataFrame:
    """Four patches of each slide."""
    return ranking.subsample(_vectors(spark, d).where("encoder = 'uni_v1'").select("vec_id", "id"), "id", "vec_id", 4)


def feature_contract(spark: SparkSession, d: str) -> DataFrame:
    """Per encoder: vectors, those of another length, without a patch, and at another place than it."""
    v = table(spark, d, "patch_features").where("vec_id IS NOT NULL AND encoder IS NOT NULL").select("vec_id", "patch_id", "encoder", "coords", "features").dropDuplicates(["vec_id"])
    p = table(spark, d, "patch_coords").where("patch_id IS NOT NULL").select("patch_id", F.col("coords").alias("at"), F.lit(1).alias("there")).dropDuplicates(["patch_id"])
    rows = v.join(p, "patch_id", "left")
    return rows.groupBy("encoder").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.size("features"), F.lit(-1)) != DIM).alias("other_length"), F.count_if(F.col("there").isNull()).alias("no_patch"), F.count_if(F.col("there").isNotNull() & ~F.col("coords").eqNullSafe(F.col("at"))).alias("elsewhere")
    )


QUERIES = {
    f.__name__: f
    for f in (
        mean_pool, mean_vectors, concat_pool, softmax_pool, abmil_pool, late_fusion, cls_mean_tokens, l2_norm, cosine_topk, rank_normalise, heatmap_avg, topk_patches, shard_batches, auc,
        cluster_assign, cluster_agreement, kmeans_sizes, projection, subsample, feature_contract,
    )
}

_OK = """WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, patch_id, id, encoder, features::DOUBLE[] AS f FROM patch_features WHERE len(features) = 64 AND encoder IS NOT NULL AND vec_id IS NOT NULL AND id IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(f, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(f, lambda x: x <> 0)) > 0)
"""
_MEAN = _OK + "SELECT encoder, id, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM (SELECT encoder, id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM ok) GROUP BY ALL"
_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS f FROM embeddings)\n"
_SCORED = """WITH p AS (SELECT DISTINCT ON (patch_id) patch_id, id AS sid, coords, patch_size_level0 AS ps FROM patch_coords WHERE patch_id IS NOT NULL AND id IS NOT NULL),
s AS (SELECT patch_id, sid, coords[1] AS x, coords[2] AS y, ps, patch_id * 37 % 101 / 100.0::DOUBLE AS score FROM p WHERE len(coords) = 2 AND coords[1] >= 0 AND coords[2] >= 0)
"""
_NEAREST = _E + ", c AS (SELECT vec_id, label, CAST(list_position(f[1:4], list_max(f[1:4])) - 1 AS INTEGER) AS cluster FROM e)\n"

SQL = {
    "mean_pool": _MEAN,
    "mean_vectors": _MEAN,
    "concat_pool": _E
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e), x AS (SELECT label, r, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM r)
SELECT label, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM x WHERE r = 1 UNION ALL SELECT label, CAST(i + 64 AS INTEGER), round(avg(v), 6) FROM x WHERE r > 1 GROUP BY label, i""",
    "softmax_pool": _E
    + """, w AS (SELECT label, f, exp(vec_id % 17 / 4.0::DOUBLE - max(vec_id % 17 / 4.0::DOUBLE) OVER (PARTITION BY label)) AS w FROM e), x AS (SELECT label, w, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM w)
SELECT label, CAST(i AS INTEGER) AS i, round(sum(w * v) / sum(w), 6) AS v FROM x GROUP BY label, i""",
    "late_fusion": _E
    + """, x AS (SELECT label, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM e), s AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2)
SELECT label % 3 AS patient, CAST(i AS INTEGER) AS i, round(avg(v), 6) AS mean FROM s GROUP BY 1, 2""",
    "cls_mean_tokens": _E
    + """, x AS (SELECT vec_id, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS k FROM e)
SELECT vec_id, CAST(k + 1 AS INTEGER) AS i, round(v, 6) AS v FROM x WHERE k < 8 UNION ALL SELECT vec_id, CAST(k % 8 + 9 AS INTEGER), round(avg(v), 6) FROM x WHERE k >= 16 GROUP BY vec_id, k % 8""",
    "l2_norm": _OK + "SELECT vec_id, round(sqrt(list_sum(list_transform(f, lambda x: x * x))), 6) AS norm FROM ok",
    "cosine_topk": _OK
    + """, p AS (SELECT q.vec_id AS query, b.vec_id, round(list_cosine_similarity(q.f, b.f), 6) AS similarity FROM ok q JOIN ok b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id AND NOT (q.encoder = b.encoder AND q.id = b.id))
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank, vec_id, similarity FROM p QUALIFY rank <= 5""",
    "rank_normalise": "SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY event_type), 9) AS rank FROM events",
    "heatmap_avg": _SCORED
    + """, c AS (SELECT sid, score, y, CAST(ceil(ps / 512.0::DOUBLE) AS BIGINT) AS side, unnest(range(CAST(ceil(x / 512.0::DOUBLE) AS BIGINT), CAST(ceil(x / 512.0::DOUBLE) + ceil(ps / 512.0::DOUBLE) AS BIGINT))) AS cx FROM s WHERE ps > 0),
h AS (SELECT sid, score, cx, unnest(range(CAST(ceil(y / 512.0::DOUBLE) AS BIGINT), CAST(ceil(y / 512.0::DOUBLE) AS BIGINT) + side)) AS cy FROM c)
SELECT sid, cx, cy, round(avg(score), 6) AS score, count(*) AS n FROM h GROUP BY 1, 2, 3""",
    "topk_patches": _SCORED
    + """, r AS (SELECT sid, patch_id, score, CAST(row_number() OVER (PARTITION BY sid ORDER BY score DESC, patch_id) AS INTEGER) AS rank_desc FROM s QUALIFY rank_desc <= 3)
SELECT *, count(*) OVER (PARTITION BY sid) - rank_desc AS file_no FROM r""",
    "shard_batches": "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS shard, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders",
    "auc": """WITH e AS (SELECT event_type, value / 20 AS score, event_id % 3 = 0 AS label FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0::DOUBLE AS r FROM e),
s AS (SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE label) AS DOUBLE) AS p, sum(r) FILTER (WHERE label) AS s, avg(CAST((score >= 0.5) = label AS INTEGER)) AS accuracy FROM r GROUP BY 1)
SELECT event_type, n, round((s - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc, round(accuracy, 9) AS accuracy FROM s""",
    "cluster_assign": _NEAREST + "SELECT vec_id, cluster FROM c",
    "cluster_agreement": _NEAREST
    + """, b AS (SELECT label, cluster, CAST(count(*) AS DOUBLE) AS c FROM c GROUP BY 1, 2), t AS (SELECT sum(c * (c - 1) / 2) AS p, sum(c) AS n FROM b),
l AS (SELECT sum(c * (c - 1) / 2) AS a FROM (SELECT sum(c) AS c FROM b GROUP BY label)), k AS (SELECT sum(c * (c - 1) / 2) AS b FROM (SELECT sum(c) AS c FROM b GROUP BY cluster))
SELECT CAST(n AS BIGINT) AS n, round((p - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM t, l, k""",
    "feature_contract": """WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, patch_id, encoder, coords, features FROM patch_features WHERE vec_id IS NOT NULL AND encoder IS NOT NULL), p AS (SELECT DISTINCT ON (patch_id) patch_id, coords AS there_at, 1 AS there FROM patch_coords WHERE patch_id IS NOT NULL)
SELECT encoder, count(*) AS n, count(*) FILTER (WHERE coalesce(len(features), -1) <> 64) AS other_length, count(*) FILTER (WHERE there IS NULL) AS no_patch, count(*) FILTER (WHERE there IS NOT NULL AND coords IS DISTINCT FROM there_at) AS elsewhere FROM v LEFT JOIN p USING (patch_id) GROUP BY 1""",
}

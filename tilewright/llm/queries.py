"""Queries of the problems tagged llm, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import table
from tilewright.llm import clusters, leakage, neighbours, packing, percentiles, personal


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patch_features").select("vec_id", F.col("encoder").alias("space"), "features")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d), 0.98).select("vec_id_a", "vec_id_b")


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that several ids have, with the smallest of these: the membership of the classes
    whose pairs p1_found does not write out."""
    return neighbours.copies(_vectors(spark, d)).select("vec_id", "representative")


#: At least 6 cells, and half of those of the query's region.
_WIDE = neighbours.Settings(probes=6, ef=256, wide=0.5)


def p1_most_similar(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of every vector whose id is divisible by 100, with coords."""
    near = neighbours.most_similar(_vectors(spark, d), 10, _WIDE, F.pmod("vec_id", F.lit(100)) == 0)
    coords = table(spark, d, "patch_features").groupBy("vec_id").agg(F.first("coords").alias("coords"))
    near = near.select("vec_id", "rank", "neighbour", F.round("similarity", 4).alias("similarity"))
    return near.join(coords.select(F.col("vec_id").alias("neighbour"), "coords"), "neighbour")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.groups(_vectors(spark, d))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(_vectors(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.outliers(table(spark, d, "task_attempts"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.reader_percentiles(table(spark, d, "task_attempts"))


def p6_days_combined(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.combine(percentiles.day_summaries(table(spark, d, "task_attempts")))


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the packs of each kind are."""
    return packing.pack_fill(p7_packs(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and the largest share held."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max("share"), 6).alias("share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders for personal data."""
    return personal.redacted(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p1_most_similar": p1_most_similar,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p6_found": p6_found,
    "p6_percentiles": p6_percentiles,
    "p6_days_combined": p6_days_combined,
    "p7_packs": p7_packs,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_leaked_items": p8_leaked_items,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_ATTEMPTS = """
WITH one AS (SELECT attempt_id, lower(trim(any_value(reader_type), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) AS reader_type, any_value(duration_s) AS duration_s FROM task_attempts WHERE attempt_id IS NOT NULL GROUP BY 1),
counted AS (SELECT * FROM one WHERE reader_type <> '' AND NOT isnan(duration_s) AND duration_s >= 0)
"""

SQL = {
    "p1_found": """
WITH v AS (SELECT vec_id, encoder, any_value(features)::DOUBLE[] AS f FROM patch_features WHERE len(features) = 64 AND encoder IS NOT NULL AND vec_id IS NOT NULL GROUP BY 1, 2),
ok AS (SELECT vec_id, encoder, f::DOUBLE[64] AS f FROM v WHERE len(list_filter(f, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(f, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM ok a JOIN ok b ON a.encoder = b.encoder AND a.vec_id < b.vec_id
WHERE array_cosine_similarity(a.f, b.f) >= 0.98""",
    "p1_copies": """
WITH v AS (SELECT vec_id, encoder, any_value(features)::DOUBLE[] AS f FROM patch_features WHERE len(features) = 64 AND encoder IS NOT NULL AND vec_id IS NOT NULL GROUP BY 1, 2),
ok AS (SELECT vec_id, encoder, f FROM v WHERE len(list_filter(f, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(f, lambda x: x <> 0)) > 0)
SELECT vec_id, min(vec_id) OVER (PARTITION BY encoder, f) AS representative FROM ok QUALIFY count(*) OVER (PARTITION BY encoder, f) > 1""",
    "p2_found": """
WITH RECURSIVE v AS (SELECT vec_id, encoder, any_value(features)::DOUBLE[] AS f FROM patch_features WHERE len(features) = 64 AND encoder IS NOT NULL AND vec_id IS NOT NULL GROUP BY 1, 2),
ok AS (SELECT vec_id, encoder, f::DOUBLE[64] AS f FROM v WHERE len(list_filter(f, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(f, lambda x: x <> 0)) > 0),
-- groups are similar throughout, so the smallest similar id is the group's
label AS (SELECT a.vec_id, min(b.vec_id) AS cluster_id FROM ok a JOIN ok b ON a.encoder = b.encoder AND array_cosine_similarity(a.f, b.f) >= 0.56 GROUP BY 1)
SELECT vec_id, cluster_id FROM label QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 5""",
    "p6_found": _ATTEMPTS
    + """, bound AS (SELECT reader_type, 5 * quantile_disc(duration_s, 0.99) AS bound FROM counted GROUP BY 1)
SELECT attempt_id FROM counted JOIN bound USING (reader_type) WHERE duration_s > bound""",
    "p6_days_combined": _ATTEMPTS
    + """, h AS (SELECT reader_type, (duration_s::DOUBLE::BIT::BIGINT) >> 42 AS i, count(*) AS k, min(duration_s) AS least, max(duration_s) AS most FROM counted GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(k) OVER (PARTITION BY reader_type ORDER BY i) AS BIGINT) AS upto, CAST(sum(k) OVER (PARTITION BY reader_type) AS BIGINT) AS n FROM h),
g AS (SELECT *, greatest(1, CAST(ceil(share * n - 1e-9) AS BIGINT)) AS rank FROM c, (SELECT CAST(unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS DOUBLE) AS share))
SELECT reader_type, share, n, rank, least, most FROM g WHERE rank <= upto AND rank > upto - k""",
    "p6_percentiles": _ATTEMPTS
    + """, ranked AS (SELECT reader_type, duration_s, row_number() OVER (PARTITION BY reader_type ORDER BY duration_s) AS rank, count(*) OVER (PARTITION BY reader_type) AS n FROM counted),
share AS (SELECT CAST(unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS DOUBLE) AS share)
SELECT reader_type, share, n, rank, duration_s FROM ranked, share WHERE rank = greatest(1, CAST(ceil(share * n - 1e-9) AS BIGINT))""",
}

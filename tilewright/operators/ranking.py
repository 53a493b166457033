"""Ranks and positions over any number of rows, heatmaps, top-k, and measures of agreement.

ranked() and numbered() sort by range and add up the sizes of ranges, so neither one key with
most of the rows nor a whole table ever passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import cut, require


def _offsets(parts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(__pid, keys..., __before): rows of the key in earlier ranges; as many rows as ranges and
    keys together."""
    by = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    totals = parts.groupBy("__pid", *keys).agg(F.sum(size).alias("__t"))
    return totals.select("__pid", *keys, F.expr(f"coalesce(sum(__t) OVER ({by}ORDER BY __pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("__before"))


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """df with the place of each row, from 0, in the order of columns that tell all rows apart."""
    require(df, *order)
    spread = cut(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    before = _offsets(spread.withColumn("__one", F.lit(1)), [], "__one")
    inside = F.expr(f"row_number() OVER (PARTITION BY __pid ORDER BY {', '.join(f'`{c}`' for c in order)})")
    placed = spread.withColumn("__in", inside).join(F.broadcast(before), "__pid")  # a row per range
    return placed.withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("long")).select(*df.columns, name)


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """df with structs __before and __after of the named columns of the rows before and after each
    row of its key, null at the ends; keys and order together tell all rows apart.

    Rows are sorted by range, so a key with most of the rows is shared by many tasks; a range
    gets its neighbours' last and first rows, two per range.
    """
    require(df, *keys, *order, *columns)
    spread = cut(df.repartitionByRange(*keys, *order).withColumn("__pid", F.spark_partition_id()))
    by = f"PARTITION BY __pid, {', '.join(f'`{k}`' for k in keys)} ORDER BY {', '.join(f'`{c}`' for c in order)}"
    row = f"struct({', '.join(f'`{c}`' for c in columns)})"
    place = F.struct(*[F.col(k) for k in (*keys, *order)])
    ends = spread.groupBy("__pid").agg(F.min(F.struct(place.alias("p"), F.expr(row).alias("r"))).alias("first"), F.max(F.struct(place.alias("p"), F.expr(row).alias("r"))).alias("last"))
    ends = ends.select("__pid", F.expr("lag(last) OVER (ORDER BY __pid)").alias("__prev"), F.expr("lead(first) OVER (ORDER BY __pid)").alias("__next"))  # a row per range
    inside = spread.withColumn("__before", F.expr(f"lag({row}) OVER ({by})")).withColumn("__after", F.expr(f"lead({row}) OVER ({by})"))
    joined = inside.join(F.broadcast(ends), "__pid")
    same = lambda side: F.expr(" AND ".join(f"`{k}` <=> {side}.p.`{k}`" for k in keys))
    before = F.coalesce("__before", F.when(same("__prev"), F.col("__prev.r")))
    after = F.coalesce("__after", F.when(same("__next"), F.col("__next.r")))
    return joined.select(*df.columns, before.alias("__before"), after.alias("__after"))


def numbered_by(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row in its key, from 1, sorted by range as in with_neighbours()."""
    require(df, *keys, *order)
    spread = cut(df.repartitionByRange(*keys, *order).withColumn("__pid", F.spark_partition_id()))
    key = F.struct(*[F.col(k) for k in keys])
    edge = spread.groupBy("__pid").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    # only the first and the last key of a range can go on in others
    counts = spread.join(F.broadcast(edge), "__pid").where(key.eqNullSafe(F.col("a")) | key.eqNullSafe(F.col("z"))).groupBy("__pid", *keys).agg(F.count("*").alias("__t"))
    names = ", ".join(f"`{k}`" for k in keys)
    before = counts.select("__pid", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.expr(f"sum(__t) OVER (PARTITION BY {names} ORDER BY __pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("__n"))
    before = before.withColumnRenamed("__pid", "__p").where("__n IS NOT NULL")
    same = F.expr(" AND ".join(["__pid = __p", *(f"`{k}` <=> __k{i}" for i, k in enumerate(keys))]))
    inside = spread.withColumn("__in", F.expr(f"row_number() OVER (PARTITION BY __pid, {names} ORDER BY {', '.join(f'`{c}`' for c in order)})"))
    joined = inside.join(F.broadcast(before), same, "left")  # two rows a range at most
    return joined.select(*df.columns, (F.col("__in") + F.coalesce("__n", F.lit(0))).cast("int").alias(name))


def rank_normalised(df: DataFrame, key: str, score: str, name: str = "rank") -> DataFrame:
    """df with the mean rank of each score in its key, ties sharing theirs, divided by the number
    of scores of the key: in (0, 1]. Null scores have null; null keys form one.

    Scores are counted by value first, the values sorted by range, and counts added up over the
    ranges.
    """
    require(df, key, score)
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(score).alias("__s")).agg(F.count("*").alias("__c"))
    spread = cut(counts.repartitionByRange("__k", "__s").withColumn("__pid", F.spark_partition_id()))
    before = _offsets(spread, ["__k"], "__c")
    total = spread.groupBy("__k").agg(F.sum("__c").alias("__n"))
    upto = F.expr("sum(__c) OVER (PARTITION BY __pid, __k ORDER BY __s)")
    placed = spread.withColumn("__upto", upto)
    placed = placed.join(before.withColumnRenamed("__k", "__k2").withColumnRenamed("__pid", "__p2"), (F.col("__pid") == F.col("__p2")) & F.col("__k").eqNullSafe(F.col("__k2")))
    placed = placed.join(total.withColumnRenamed("__k", "__k3"), F.col("__k").eqNullSafe(F.col("__k3")))
    mean = F.col("__before") + F.col("__upto") - (F.col("__c") - 1) / 2
    ranks = placed.select(F.col("__k").alias("__key"), F.col("__s").alias("__score"), (mean / F.col("__n")).alias(name))
    return df.join(ranks, F.col(key).eqNullSafe(F.col("__key")) & (F.col(score) == F.col("__score")), "left").select(*df.columns, name)


def top_patches(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k rows of the highest score of each key, with rank_desc (1 = highest) and file_no, the
    number in a file name, which counts from the lowest of the k. Ties go to the smaller `tie`.
    Ranks are limited before the shuffle, so a key sends at most k rows per task."""
    order = f"ORDER BY {score} DESC, {tie}"
    best = df.where(F.col(score).isNotNull()).withColumn("rank_desc", F.expr(f"row_number() OVER (PARTITION BY {key} {order})")).where(F.col("rank_desc") <= k)
    return best.withColumn("file_no", F.expr(f"count(*) OVER (PARTITION BY {key})") - F.col("rank_desc"))


def heatmap(patches: DataFrame, scale: float, cells: int | None = None) -> DataFrame:
    """(sid, cx, cy, score, n): the mean score of the patches (sid, x, y, ps, score) that cover each
    cell of a slide drawn at `scale`; corners and sizes are rounded up. Cells that no patch covers
    have no row. Sums are combined before the shuffle. Null scores or places don't count. A
    region of cells x cells cuts off what lies beyond, if given."""
    require(patches, "sid", "x", "y", "ps", "score")
    at = lambda c: F.ceil(F.col(c) * F.lit(float(scale))).cast("long")
    rows = patches.where("x IS NOT NULL AND y IS NOT NULL AND score IS NOT NULL AND ps > 0").select("sid", "score", at("x").alias("cx0"), at("y").alias("cy0"), at("ps").alias("side"))
    rows = rows.withColumn("cx", F.explode(F.sequence(F.col("cx0"), F.col("cx0") + F.col("side") - 1))).withColumn("cy", F.explode(F.sequence(F.col("cy0"), F.col("cy0") + F.col("side") - 1)))
    if cells is not None:
        rows = rows.where((F.col("cx") < cells) & (F.col("cy") < cells) & (F.col("cx") >= 0) & (F.col("cy") >= 0))
    return rows.groupBy("sid", "cx", "cy").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def shards(df: DataFrame, order: list[str], n: int, batch: int) -> DataFrame:
    """df with shard (round robin over n) and batch (of fixed size), by the place in the order."""
    return numbered(df, order, "__row").withColumn("shard", (F.col("__row") % n).cast("int")).withColumn("batch", F.floor(F.col("__row") / batch).cast("long")).drop("__row")


def subsample(df: DataFrame, key: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows a key with their draw (1..n): without repeats if the key has n, else each
    row as often as any other or once more. The draw follows from seed and ids alone."""
    require(df, key, row_id)
    order = f"xxhash64({seed}, `{row_id}`), `{row_id}`"
    ranked = df.withColumn("__r", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY {order})")).where(F.col("__r") <= n)
    sized = ranked.withColumn("__n", F.expr(f"count(*) OVER (PARTITION BY `{key}`)"))
    return sized.withColumn("draw", F.explode(F.sequence(F.col("__r").cast("long"), F.lit(n).cast("long"), F.col("__n")))).drop("__r", "__n")


def split(key: Column, share: float, seed: int = 0) -> Column:
    """'train' or 'test' by a hash of the key, so that rows of one key stay together."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)), "train").otherwise("test")


def nearest_centroid(df: DataFrame, centroids: list[list[float]], features: str = "features", name: str = "cluster") -> DataFrame:
    """df with the number of the nearest centroid (squared distance, of equals the smaller)."""
    f = F.col(features)
    far = [F.aggregate(F.zip_with(f, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for centre in centroids]
    return df.withColumn(name, (F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1).cast("int"))


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 1, name: str = "cluster") -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=name).fit(ready)
    return model.transform(ready).drop("__v")


def projected(df: DataFrame, k: int = 2, features: str = "features", name: str = "projection") -> DataFrame:
    """df with its first k principal components as an array."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(ready).transform(ready).withColumn(name, vector_to_array("__p")).drop("__v", "__p")


def agreement(df: DataFrame, one: str, two: str) -> DataFrame:
    """(n, ari): the adjusted Rand index of two labellings, from counts of their pairs alone."""
    pairs = lambda c: c * (c - 1) / 2
    both = df.groupBy(one, two).agg(F.count("*").cast("double").alias("c"))
    of = lambda k: both.groupBy(k).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(f"p_{k}"), F.sum("c").alias(f"n_{k}"))
    cells = both.agg(F.sum(pairs(F.col("c"))).alias("p"))
    joined = cells.join(of(one)).join(of(two))  # one row each
    n, a, b, p = F.col(f"n_{one}"), F.col(f"p_{one}"), F.col(f"p_{two}"), F.col("p")
    chance = a * b / F.nullif(pairs(n), F.lit(0.0))
    return joined.select(n.cast("long").alias("n"), ((p - chance) / F.nullif((a + b) / 2 - chance, F.lit(0.0))).alias("ari"))


def auc(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """(key, n, auc, accuracy): area under the curve of a 0/1 label by mean ranks, and the share of
    rows whose score is at least 0.5 exactly if the label is 1. Null without both labels."""
    rows = rank_normalised(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()), key, score, "__r")
    positive = F.col(label) == 1
    stats = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(positive).alias("p"), F.sum(F.when(positive, F.col("__r"))).alias("s"), F.avg(F.when((F.col(score) >= 0.5) == positive, 1.0).otherwise(0.0)).alias("accuracy")
    )
    p, n = F.col("p"), F.col("n")
    value = (F.col("s") * n - p * (p + 1) / 2) / F.nullif((p * (n - p)).cast("double"), F.lit(0.0))
    return stats.select(key, "n", value.alias("auc"), "accuracy")


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = None
    for holds, name in rules:
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    if out is None:
        raise ValueError("no rules")
    return out

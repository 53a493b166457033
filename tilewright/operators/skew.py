"""Per-key results when a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import cut, folded, require

_CHUNK = "__chunk"

#: How the partial state of each measure is merged with others of its kind.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, Column]],
    fan_in: int = 8,
    chunks: int | None = None,
) -> DataFrame:
    """One row per key with the measures, however uneven the keys are.

    measures: name -> (kind, expression), kind being count (of non-null values), sum, min or max.
    A task reduces the chunk of the input that it reads, before anything moves; each round then
    merges the states of fan_in neighbouring chunks of a key, so no task ever receives more than
    fan_in states of one key, and the rows themselves never move. The number of rounds is
    log(chunks) to the base fan_in.

    Null keys form one group, as in GROUP BY. Empty input gives no rows. Columns that are not
    named in keys or measures are ignored, whatever their names.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    for kind, _ in measures.values():
        if kind not in _MERGE:
            raise ValueError(f"unknown kind of measure: {kind}")
    require(df, *keys)
    conf = df.sparkSession.conf
    chunks = chunks or max(2, int(conf.get("spark.sql.shuffle.partitions")))
    names = [f"__m{i}" for i in range(len(measures))]
    rows = df.select(
        *keys,
        F.pmod(F.spark_partition_id(), F.lit(chunks)).alias(_CHUNK),
        *[e.alias(n) for n, (_, e) in zip(names, measures.values())],
    )
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    state, merge = rows, first
    rounds = max(1, math.ceil(math.log(chunks, fan_in) - 1e-9))
    for level in range(1, rounds + 1):
        by = [*keys, F.floor(F.col(_CHUNK) / fan_in).cast("int").alias(_CHUNK)] if level < rounds else keys
        state = state.groupBy(*by).agg(*[merge[kind](F.col(n)).alias(n) for n, (kind, _) in zip(names, measures.values())])
        merge = _MERGE
    return state.select(*keys, *[F.col(n).alias(alias) for n, alias in zip(names, measures)])


def distinct_patches(coords: DataFrame, *columns: str) -> DataFrame:
    """One row per patch_id (repeats are equal in all columns); a patch_id that is itself
    repeated very often is reduced before the shuffle. Rows without patch_id are no record."""
    require(coords, "patch_id", *columns)
    rows = coords.where(F.col("patch_id").isNotNull())
    return rows.groupBy("patch_id").agg(*[F.first(c).alias(c) for c in columns])


def slide_extents(coords: DataFrame) -> DataFrame:
    """Per name (folded) and slide id: number of patches, of located ones, and their extent.

    A patch is located if its coords are two non-null, non-negative numbers; others count as
    patches only. Null names and ids form groups of their own. Slides without a located patch
    have a null extent. Ties and repeated rows don't matter; an empty table gives no rows.
    """
    rows = distinct_patches(coords, "name", "id", "coords")
    x, y = F.get(F.col("coords"), F.lit(0)), F.get(F.col("coords"), F.lit(1))
    good = F.coalesce((F.size("coords") == 2) & (x >= 0) & (y >= 0), F.lit(False))
    rows = rows.select(folded("name").alias("name"), "id", "patch_id", F.when(good, x).alias("x"), F.when(good, y).alias("y"))
    return tree_aggregate(
        rows,
        ["name", "id"],
        {
            "n_patches": ("count", F.col("patch_id")),
            "n_located": ("count", F.col("x")),
            "min_x": ("min", F.col("x")),
            "min_y": ("min", F.col("y")),
            "max_x": ("max", F.col("x")),
            "max_y": ("max", F.col("y")),
        },
    )


def heavy_names(coords: DataFrame, percent: int = 1) -> DataFrame:
    """Names (folded) with at least `percent` per cent of all different patch_ids.

    Patches without a name count towards the whole but are no name. An empty table gives no rows.
    """
    rows = distinct_patches(coords, "name").select(folded("name").alias("name"), "patch_id")
    per_name = cut(tree_aggregate(rows, ["name"], {"n_patches": ("count", F.col("patch_id"))}))
    view = f"per_name_{id(per_name)}"
    per_name.createOrReplaceTempView(view)
    try:
        return coords.sparkSession.sql(
            f"SELECT name, n_patches FROM {view} WHERE name IS NOT NULL"
            f" AND n_patches * 100 >= {int(percent)} * (SELECT sum(n_patches) FROM {view})"
        )
    finally:
        coords.sparkSession.catalog.dropTempView(view)

"""Slide vectors from patch vectors, and vectors as rows.

Vectors are arrays in a column; a result is one row per key and dimension (i from 1), or an array
where a function says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import require


def valid(features: Column, dim: int) -> Column:
    """Whether a vector has `dim` finite numbers that are not all zero."""
    finite = F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(features) == dim) & finite & F.exists(features, lambda v: v != 0), F.lit(False))


def rows_of(df: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """(keys..., i, v), i from 1."""
    return df.select(*keys, F.posexplode(features).alias("__i", "__v")).select(*keys, (F.col("__i") + 1).alias("i"), F.col("__v").cast("double").alias("v"))


def mean_pool(df: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """(keys..., i, mean): the mean vector of each key, by dimension. Sums and counts are combined
    before the shuffle, so a key with most of the rows sends a few rows per task. Null vectors
    and elements don't count."""
    return rows_of(df, keys, features).groupBy(*keys, "i").agg(F.avg("v").alias("mean"))


def mean_vectors(df: DataFrame, keys: list[str], dim: int, features: str = "features") -> DataFrame:
    """(keys..., n, features): mean_pool() as one array a key, without the rows of every
    dimension: each task sums its vectors in Arrow batches, the sums of tasks are merged. Vectors
    of another length than dim don't count."""
    require(df, *keys, features)
    rows = df.where(F.size(features) == dim).select(*keys, F.col(features).cast("array<double>").alias("__f"))
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(len(keys)).flatten()).reshape(-1, dim)
            keyed = pa.table({k: batch.column(i) for i, k in enumerate(keys)}).append_column("__n", pa.array(np.ones(len(x), dtype=np.int64)))
            own: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(keyed.column(k).to_pylist() for k in keys))):
                own.setdefault(key, []).append(r)
            out = [(*key, len(at), x[at].sum(axis=0)) for key, at in own.items()]
            arrays = [pa.array([o[i] for o in out], batch.schema.field(i).type) for i in range(len(keys))]
            flat = pa.array(np.concatenate([o[-1] for o in out]))
            yield pa.record_batch([*arrays, pa.array([o[-2] for o in out], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), flat)], names=[*keys, "n", "s"])

    part = rows.mapInArrow(sums, f"{fields}, n bigint, s array<double>")
    total = part.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"__s{i}") for i in range(dim)])
    return total.select(*keys, "n", F.array(*[F.col(f"__s{i}") / F.col("n") for i in range(dim)]).alias("features"))


def concat_pool(df: DataFrame, keys: list[str], order: str, skip: int = 1, features: str = "features") -> DataFrame:
    """(keys..., i, v): the first vector of each key by `order`, then the mean of those after the
    first `skip`, one behind the other."""
    first = df.groupBy(*keys).agg(F.min_by(features, order).alias("__first"))
    # the first few are told by a limited rank, so no key is sorted; the rest is all less these
    skipped = df.withColumn("__r", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})")).where(F.col("__r") <= skip)
    sums = lambda rows: rows_of(rows, keys, features).groupBy(*keys, "i").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    both = sums(df).unionByName(sums(skipped).select(*keys, "i", (-F.col("s")).alias("s"), (-F.col("n")).alias("n"))).groupBy(*keys, "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rest = both.where("n > 0").select(*keys, "i", (F.col("s") / F.col("n")).alias("v"))
    head = rows_of(first, keys, "__first")
    size = first.select(*keys, F.size("__first").alias("__n"))
    return head.unionByName(rest.join(size, keys).select(*keys, (F.col("i") + F.col("__n")).alias("i"), "v"))


def softmax_pool(df: DataFrame, keys: list[str], score: str, features: str = "features") -> DataFrame:
    """(keys..., i, v): the mean of the vectors of a key, weighted by the softmax of their scores.
    The largest score and the sums are aggregates, so no key is gathered or sorted. Null scores
    don't count."""
    rows = df.where(F.col(score).isNotNull())
    top = rows.groupBy(*keys).agg(F.max(score).alias("__top"))
    weighed = rows.join(top, keys).withColumn("__w", F.exp(F.col(score) - F.col("__top")))
    flat = weighed.select(*keys, "__w", F.posexplode(features).alias("__i", "__v"))
    return flat.groupBy(*keys, (F.col("__i") + 1).alias("i")).agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("v"))


class Attention:
    """Gated attention over the vectors of a slide (weights fixed from a seed; there is no trained
    model here): per head softmax(w . (tanh(V h) * sigmoid(U h))), heads behind each other."""

    def __init__(self, dim: int, hidden: int = 16, heads: int = 1, gated: bool = True, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(dim), s)
        self.v, self.u, self.w = draw(heads, dim, hidden), draw(heads, dim, hidden), draw(heads, hidden)
        self.gated, self.dim, self.heads = gated, dim, heads

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(heads, n)"""
        h = np.tanh(np.einsum("nd,hdk->hnk", x, self.v))
        if self.gated:
            h = h / (1 + np.exp(-np.einsum("nd,hdk->hnk", x, self.u)))
        return np.einsum("hnk,hk->hn", h, self.w)


def attention_pool(df: DataFrame, keys: list[str], model: Attention, features: str = "features") -> DataFrame:
    """(keys..., i, v): attention pooling of any number of vectors a key. Each batch is scored
    where it lies and reduced to (largest score, sum of weights, weighted sum) per key and head;
    these states are merged by rescaling, so no task holds the vectors of a key."""
    require(df, *keys, features)
    rows = df.where(F.size(features) == model.dim).select(*keys, F.col(features).cast("array<double>").alias("__f"))
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(len(keys)).flatten()).reshape(-1, model.dim)
            s = model.scores(x)
            own: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))):
                own.setdefault(key, []).append(r)
            out = []
            for key, at in own.items():
                for h in range(model.heads):
                    top = s[h, at].max()
                    w = np.exp(s[h, at] - top)
                    out.append((*key, h, float(top), float(w.sum()), (w @ x[at]).tolist()))
            arrays = [pa.array([o[i] for o in out], batch.schema.field(i).type) for i in range(len(keys))]
            rest = [pa.array([o[len(keys) + i] for o in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))]
            yield pa.record_batch([*arrays, *rest], names=[*keys, "h", "top", "w", "s"])

    part = rows.mapInArrow(states, f"{fields}, h int, top double, w double, s array<double>")
    best = part.groupBy(*keys, "h").agg(F.max("top").alias("__best"))
    scaled = part.join(best, [*keys, "h"]).withColumn("__f", F.exp(F.col("top") - F.col("__best")))
    flat = scaled.select(*keys, "h", "__f", "w", F.posexplode("s").alias("__i", "__v"))
    return flat.groupBy(*keys, (F.col("h") * model.dim + F.col("__i") + 1).alias("i")).agg((F.sum(F.col("__f") * F.col("__v")) / F.sum(F.col("__f") * F.col("w"))).alias("v"))


def slide_encoder(df: DataFrame, keys: list[str], encode: Callable[[np.ndarray, np.ndarray], np.ndarray], order: str = "patch_idx") -> DataFrame:
    """(keys..., features): a user's encoder of all vectors (n, d) and coords (n, 2) of a slide, in
    the order of `order`. A slide goes to one task as a whole, as its encoder wants it; use the
    poolings above where a slide may be too large for that."""
    fields = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        vector = np.asarray(encode(np.array(table.column("features").to_pylist(), dtype=float), np.array(table.column("coords").to_pylist())), dtype=float).reshape(-1)
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key)}, "features": [vector.tolist()]})

    return df.select(*keys, order, "features", "coords").groupBy(*keys).applyInArrow(run, f"{fields}, features array<double>")


def l2_norm(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_topk(base: DataFrame, queries: DataFrame, k: int, dim: int, apart: bool = False, block: int = 4096) -> DataFrame:
    """(query, rank, vec_id, similarity): the k most similar vectors of base (vec_id, part,
    features) for each of queries (the same columns), exactly; with apart, of other parts only.

    Queries are taken `block` at a time, each block in one pass over base: a task keeps its k
    best a query, and the tasks' best are ranked. Of equal similarities the smaller id is first;
    similarities are compared at six digits. Invalid vectors take no part.
    """
    good = lambda df: df.where(valid(F.col("features"), dim)).select(F.col("vec_id").cast("bigint"), F.col("part").cast("string").alias("part"), F.col("features").cast("array<double>").alias("features"))
    asked, rows = good(queries), good(base)
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).collect()
        found = _block(rows, own, k, dim, apart)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "vec_id", "similarity")


def _block(rows: DataFrame, own: list, k: int, dim: int, apart: bool) -> DataFrame:
    q = np.array([r["features"] for r in own], dtype=float).reshape(-1, dim)
    q /= np.sqrt((q**2).sum(axis=1, keepdims=True)) if len(q) else 1
    given = rows.sparkSession.sparkContext.broadcast((q, np.array([r["vec_id"] for r in own], dtype=np.int64), np.array([r["part"] for r in own], dtype=object)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, parts = given.value
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            x = np.asarray(batch.column(2).flatten()).reshape(-1, dim)
            own, part = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
            s = np.round(q @ (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).T, 6)
            s[ids[:, None] == own[None, :]] = -9
            if apart:
                s[parts[:, None] == part[None, :]] = -9
            order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
            best = np.take_along_axis(s, order, axis=1)
            r, c = np.nonzero(best > -9)
            yield pa.record_batch([pa.array(ids[r]), pa.array(own[order[r, c]]), pa.array(best[r, c])], names=["query", "vec_id", "similarity"])

    return rows.mapInArrow(run, "query bigint, vec_id bigint, similarity double")

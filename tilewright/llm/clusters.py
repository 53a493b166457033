"""Groups of similar vectors by Markov clustering of their similarity graph, level by level.

First level: the vectors of a shard (see neighbours) and the links of their small-world graph
that are similar enough form a block of the matrix. Columns sum to one; the block is squared
(flow spreads), inflated (strong flow gains) and pruned (weak flow ends), until flow settles: the
rows that still hold it are attractors, and a column's strongest attractor is its cluster. The
clusters, linked by all links between their members, are the nodes of the next round in the
block, until no link of the block leads out of a cluster.

Higher levels: the clusters of all blocks, each known by its attractor, are searched for each
other, and the matrix of the links found is squared, inflated and pruned as a distributed table.
That is repeated until no two attractors are similar any more, and what pruning leaves out of one
round is met again in the next.

At the end all pairs of vectors of different clusters are bounded or compared (see bridges), and
clusters with a pair that is similar enough are one. So no pair is left out, whatever the graphs,
beams and probes have missed, and it makes no difference how the vectors were shared out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.common import cut, require, written
from tilewright.llm import bridges, neighbours
from tilewright.llm.hnsw import Graph


@dataclass(frozen=True)
class Settings:
    """together: cosine similarity from which two vectors belong together. width: entries of a
    column that pruning leaves in a block; keep: in the distributed matrix. iterations: squarings
    of a round, which ends before when all but the share `moving` of the columns have settled;
    flow that has not settled by then settles in the next. build: width of the beam, forward and
    back links of a graph that is clustered. links: neighbours that a
    cluster is searched for on the higher levels. salts: parts of a row of the matrix."""

    dim: int = 64
    together: float = 0.56
    width: int = 6
    build: tuple[int, int, int] = (8, 6, 10)
    keep: int = 32
    inflation: float = 2.0
    prune: float = 1e-3
    iterations: int = 12
    settled: float = 5e-2
    moving: float = 0.05
    links: int = 32
    salts: int = 4


def _columns(n: int, a: np.ndarray, b: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values), n x width, of the columns that links (a, b, v) make: the strongest of
    each column, of equals those given first, with a loop as strong as the strongest; -1 and 0
    where there are fewer."""
    rows, values = np.full((n, width), -1, dtype=np.int32), np.zeros((n, width), dtype=np.float32)
    rows[:, 0] = np.arange(n)
    values[:, 0] = 1
    strength = v.astype(np.float32).view(np.int32).astype(np.int64)  # bits of positive numbers are in their order
    by = np.argsort((a.astype(np.int64) << 32) - strength, kind="stable")
    a, b, v = a[by], b[by], v[by]
    first = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - first[a]
    has = np.nonzero(rank == 0)[0]
    values[a[has], 0] = v[has]
    keep = rank < width - 1
    rows[a[keep], rank[keep] + 1], values[a[keep], rank[keep] + 1] = b[keep], v[keep]
    return rows, values / values.sum(axis=1, keepdims=True)


def _squared(rows: np.ndarray, values: np.ndarray, inflation: float, prune: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns squared, inflated and pruned; and the flow into each row by the squaring alone.
    Entries of a column are on its left, here and in the result."""
    n = len(rows)
    out_rows, out_values = np.full((n, width), -1, dtype=np.int32), np.zeros((n, width), dtype=np.float32)
    flow = np.zeros(n, dtype=np.float64)
    held = (rows >= 0).sum(axis=1)
    order = np.argsort(held, kind="stable")  # columns of few entries make few products
    for lo in range(0, n, 8192):
        at = order[lo : lo + 8192]
        r, v = rows[at, : held[at[-1]]], values[at, : held[at[-1]]]
        most = int(held[r[r >= 0]].max())
        i = rows[:, :most].take(r, axis=0, mode="wrap")
        i[r < 0] = -1
        x = (v[:, :, None] * values[:, :most].take(r, axis=0, mode="wrap")).reshape(-1)
        # sorted by their rows, with their places as the low bits
        m = r.shape[1] * most
        bits = (m - 1).bit_length()
        key = i.reshape(len(at), m).astype(np.int32 if n << bits < 1 << 31 else np.int64)
        key = np.sort((key << bits) | np.arange(m, dtype=key.dtype), axis=1)
        x = x.take((key & ((1 << bits) - 1)) + (np.arange(len(at)) * m)[:, None]).reshape(-1)
        i = key >> bits
        new = np.ones(i.shape, dtype=bool)
        new[:, 1:] = i[:, 1:] != i[:, :-1]
        start, sums = np.flatnonzero(new), np.bincount(np.cumsum(new) - 1, weights=x)
        i, j = i.take(start), start // m
        some = np.flatnonzero(i >= 0)
        i, j, sums = i.take(some), j.take(some), sums.take(some)
        flow += np.bincount(i, weights=sums, minlength=n)
        strong = sums**inflation
        strong /= np.bincount(j, weights=strong).take(j)
        least = np.minimum(prune, np.maximum.reduceat(strong, np.flatnonzero(np.diff(j, prepend=-1))))
        some = np.flatnonzero(strong >= least.take(j))
        i, j, strong = i.take(some), j.take(some), strong.take(some)
        count = np.bincount(j, minlength=len(at))
        first = np.cumsum(count) - count
        grid = np.zeros((len(at), max(width, int(count.max()))))
        grid[j, np.arange(len(j)) - first.take(j)] = strong
        top = np.argpartition(-grid, width - 1, axis=1)[:, :width]
        s = np.take_along_axis(grid, top, axis=1)
        by = np.argsort(-s, axis=1)
        s, top = np.take_along_axis(s, by, axis=1), np.take_along_axis(top, by, axis=1)
        out_values[at] = s / s.sum(axis=1, keepdims=True)
        out_rows[at] = np.where(s > 0, i.take(first[:, None] + top, mode="clip"), -1)
    return out_rows, out_values, flow


def markov(n: int, a: np.ndarray, b: np.ndarray, v: np.ndarray, settings: Settings, inflation: float) -> tuple[np.ndarray, np.ndarray]:
    """(attractor of each node, flow of the first squaring into each) for links (a, b, v) that are
    there in both directions."""
    rows, values = _columns(n, a, b, v, settings.width)
    early = None
    for _ in range(settings.iterations):
        rows, values, flow = _squared(rows, values, inflation, settings.prune, settings.width)
        early = flow if early is None else early
        moving = (values.max(axis=1) - (values**2).sum(axis=1)) >= settings.settled
        if moving.mean() <= settings.moving:
            break
    strongest = np.where(values >= 0.5 * values.max(axis=1, keepdims=True), rows, n)
    return np.where(strongest >= 0, strongest, n).min(axis=1), early if early is not None else np.zeros(n)


def _strongest(n: int, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each node's strongest partner or itself, the smaller of both where it is mutual."""
    to = np.arange(n)
    by = np.lexsort((b, -v, a))
    own, first = np.unique(a[by], return_index=True)
    to[own] = b[by][first]
    mutual = to[to] == np.arange(n)
    return np.where(mutual, np.minimum(to, np.arange(n)), to)


def block(n: int, a: np.ndarray, b: np.ndarray, v: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """(attractor of each node, flow into each node) of a block: Markov clustering of links
    (a, b, v), in any direction, round by round until no link leads out of a cluster. A round
    that joins nothing is repeated with less inflation; flow that still stays where it is
    follows the strongest link."""
    keep = a != b
    lo, hi, v = np.minimum(a[keep], b[keep]).astype(np.int64), np.maximum(a[keep], b[keep]).astype(np.int64), v[keep]
    _, first = np.unique(lo * n + hi, return_index=True)
    lo, hi, v = lo[first], hi[first], v[first].astype(np.float64)
    label, early, inflation = np.arange(n), None, settings.inflation
    nodes = np.arange(n)  # the attractor that each node of this round stands for
    while True:
        a, b, w = np.concatenate([hi, lo]), np.concatenate([lo, hi]), np.concatenate([v, v])  # of a, b rises
        if early is None or len(a):
            to, flow = markov(len(nodes), a, b, w, settings, inflation) if inflation > 1.05 else (_strongest(len(nodes), a, b, w), np.zeros(len(nodes)))
            early = flow if early is None else early
        if not len(a):
            return nodes[label], early
        for _ in range(8):  # an attractor's attractor
            to = to[to]
        kept, number = np.unique(to, return_inverse=True)
        if len(kept) == len(nodes):
            inflation = 1 + (inflation - 1) / 2
            continue
        inflation = settings.inflation
        label, nodes = number[label], nodes[kept]
        lo, hi = number[lo], number[hi]
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        out = lo != hi
        key, at = np.unique(lo[out] * len(kept) + hi[out], return_inverse=True)
        v = np.bincount(at, weights=v[out], minlength=len(key))
        lo, hi = key // len(kept), key % len(kept)


BLOCKS = "space string, vec_id bigint, node bigint, flow double, code binary, size bigint, total binary"


def blocks(ix: neighbours.Index, settings: Settings) -> DataFrame:
    """The first level: each vector (of copies the one with the smallest id) with the attractor of
    its cluster, the flow into it and its code; the rows of attractors hold the size of the cluster
    and the sum of its vectors."""
    s, ns = settings, ix.settings
    few = ix.repeated.select("space", "key", "rep")
    rows = ix.rows.join(F.broadcast(few) if ix.small else few, ["space", "key"], "left")
    cell = F.col("cells")[0].alias("cell")
    again = rows.where("rep IS NOT NULL").groupBy("space", "key", F.col("rep").alias("vec_id")).agg(F.first(F.col("cells")[0]).alias("cell"), F.first("code").alias("code"))
    one = rows.where("rep IS NULL").select("space", "key", "vec_id", cell, "code").unionByName(again)
    shards = one.groupBy("space", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ns.shard)).cast("int").alias("shards"))
    parts = one.join(F.broadcast(shards), ["space", "cell"]).select("space", "cell", F.pmod("key", "shards").cast("int").alias("shard"), "vec_id", "code")

    def solve(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("vec_id").to_numpy(), return_index=True)
        code = table.column("code").combine_chunks().take(pa.array(at))
        x = neighbours.decoded(code, s.dim)
        graph = Graph(x, ids, *s.build)
        a, b, v = graph.links()
        keep = v >= s.together + bridges.SLACK
        to, flow = block(len(ids), a[keep], b[keep], v[keep], s)
        by = np.argsort(to, kind="stable")
        own, first, size = np.unique(to[by], return_index=True, return_counts=True)
        sizes, totals = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), None, dtype=object)
        sizes[own], totals[own] = size, [t.tobytes() for t in np.add.reduceat(x[by], first, axis=0)]
        columns = [pa.array([table.column("space")[0].as_py()] * len(ids), pa.string()), pa.array(ids), pa.array(ids[to]), pa.array(flow, pa.float64()), code, pa.array(sizes), pa.array(totals.tolist(), pa.binary())]
        return pa.table(columns, names=["space", "vec_id", "node", "flow", "code", "size", "total"])

    return parts.groupBy("space", "cell", "shard").applyInArrow(solve, BLOCKS)


def _scaled(m: DataFrame) -> DataFrame:
    """Columns that sum to one."""
    total = m.groupBy("j").agg(F.sum("v").alias("total"))
    return m.join(total, "j").select("i", "j", (F.col("v") / F.col("total")).alias("v"))


def _pruned(m: DataFrame, settings: Settings) -> DataFrame:
    """The strongest entries of each column."""
    ranked = m.withColumn("r", F.expr("row_number() OVER (PARTITION BY j ORDER BY v DESC, i)"))
    return ranked.where((F.col("r") <= settings.keep) & ((F.col("v") >= settings.prune) | (F.col("r") == 1))).select("i", "j", "v")


def flow(links: DataFrame, settings: Settings = Settings(), inflation: float | None = None) -> DataFrame:
    """Markov clustering of links (i, j, v), given in both directions and without loops, as a
    distributed table: (node, attractor). Columns are pruned before they are squared, so each
    yields at most keep x keep products; a row that many columns share is split by salt."""
    s = settings
    loops = links.groupBy("j").agg(F.max("v").alias("v")).select(F.col("j").alias("i"), "j", "v")
    m = cut(_scaled(_pruned(links.select("i", "j", "v").unionByName(loops), s)))
    for _ in range(s.iterations):
        columns = m.groupBy(F.col("j").alias("k")).agg(F.collect_list(F.struct("i", "v")).alias("entries"))  # at most keep
        columns = columns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
        entries = m.select(F.col("i").alias("k"), "j", F.col("v").alias("y"), F.pmod(F.xxhash64("j"), F.lit(s.salts)).cast("int").alias("salt"))
        product = entries.join(columns, ["k", "salt"]).select("j", "y", F.inline("entries"))
        squared = product.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("y")).alias("v"))
        strong = _scaled(squared.select("i", "j", F.pow("v", F.lit(inflation or s.inflation)).alias("v")))
        m = cut(_scaled(_pruned(strong, s)))
        moved = m.groupBy("j").agg((F.max("v") - F.sum(F.col("v") * F.col("v"))).alias("c")).agg(F.max("c")).first()[0]
        if moved is None or moved < s.settled:
            break
    peak = m.groupBy("j").agg(F.max("v").alias("peak"))
    return m.join(peak, "j").where(F.col("v") >= F.col("peak") * 0.5).groupBy(F.col("j").alias("node")).agg(F.min("i").alias("attractor"))


def _higher(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, cluster) of the clusters of the first level (vec_id, space, features)."""
    s = settings
    of, inflation, n = None, s.inflation, nodes.count()
    while True:
        ix = neighbours.index(nodes, neighbours.Settings(dim=s.dim, probes=4, ef=2 * s.links))
        found = written(neighbours.search(ix, s.links).where(F.col("similarity") >= s.together + 2 * bridges.SLACK), "links")
        one = found.select(F.col("vec_id").alias("i"), F.col("neighbour").alias("j"), F.col("similarity").cast("double").alias("v"))
        links = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.max("v").alias("v"))
        if found.isEmpty():
            return of if of is not None else nodes.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("cluster"))
        if inflation > 1.05:
            step = flow(links, s, inflation)
        else:  # flow that stays where it is follows the strongest link to a smaller id
            step = links.where("i < j").groupBy(F.col("j").alias("node")).agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("attractor"))
        step = cut(step)
        to = nodes.select(F.col("vec_id").alias("node")).join(step, "node", "left").select("node", F.coalesce("attractor", "node").alias("cluster"))
        of = cut(to if of is None else of.withColumnRenamed("cluster", "c").join(to.withColumnRenamed("node", "c"), "c").select("node", "cluster"))
        fewer = written(nodes.join(of.select(F.col("cluster").alias("vec_id")).distinct(), "vec_id", "left_semi"), "nodes")
        left = fewer.count()
        inflation = s.inflation if left < n else 1 + (inflation - 1) / 2
        nodes, n = fewer, left


def clustered(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, cluster, flow): every valid vector with its cluster and the flow into it."""
    require(vectors, "vec_id", "space", "features")
    ix = neighbours.index(vectors, neighbours.Settings(dim=settings.dim), queries=F.lit(False))
    first = written(blocks(ix, settings), "blocks")
    dim = settings.dim

    def vector(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = neighbours.decoded(batch.column(2), dim)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.reshape(-1), pa.float32()))
            yield pa.record_batch([batch.column(0), batch.column(1), values], names=["vec_id", "space", "features"])

    heads = first.where("size > 0")
    nodes = heads.select("vec_id", "space", "code").mapInArrow(vector, "vec_id bigint, space string, features array<float>")
    of = _higher(written(nodes, "nodes"), settings)
    few = of.limit(neighbours.SMALL + 1).count() <= neighbours.SMALL
    rows = first.join(F.broadcast(of) if few else of, "node").select("space", "vec_id", "cluster", "flow", "code")
    parts = heads.join(F.broadcast(of) if few else of, "node").select("space", "cluster", "size", "total")
    tied = bridges.bridged(rows, parts, vectors, settings.together, dim)
    rows = rows.select("vec_id", "cluster", "flow")
    if tied is not None:
        rows = rows.join(tied.withColumnRenamed("node", "cluster"), "cluster", "left").select("vec_id", F.coalesce("least", "cluster").alias("cluster"), "flow")
    if ix.repeated.where("last > rep").isEmpty():
        return rows
    copies = neighbours.members(ix).where("vec_id <> rep").select("rep", "vec_id")
    same = rows.withColumnRenamed("vec_id", "rep").join(copies, "rep").select("vec_id", "cluster", "flow")
    return rows.unionByName(same)


def _sized(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("vec_id").alias("cluster_id")).where(F.col("size") >= least)


def groups(vectors: DataFrame, least: int = 5, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, cluster_id): the valid vectors in groups of at least `least` different ones;
    cluster_id is the smallest vec_id of the group.

    A vector that occurs twice counts once; copies under several ids count each. Null, empty,
    short, zero and non-finite vectors belong to no group. Ties of flow go to the smaller id. An
    empty table gives no rows; other columns are ignored.
    """
    rows = written(clustered(vectors, settings).select("vec_id", "cluster"), "members")
    return rows.join(_sized(rows, least), "cluster").select("vec_id", "cluster_id")


def described(vectors: DataFrame, least: int = 5, typical: int = 3, settings: Settings = Settings()) -> DataFrame:
    """(cluster_id, size, typical): each group with its size and its most typical members, those
    of all its vectors that the flow of the first squaring reaches most, of equals the smaller
    id (a copy has the flow of its vector); cases as in groups()."""
    rows = written(clustered(vectors, settings), "members")
    # the few strongest of each part first, so that no task sorts a whole group
    part = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    order = "ORDER BY flow DESC, vec_id"
    part = part.withColumn("r", F.expr(f"row_number() OVER (PARTITION BY cluster, part {order})")).where(F.col("r") <= typical)
    best = part.withColumn("r", F.expr(f"row_number() OVER (PARTITION BY cluster {order})")).where(F.col("r") <= typical)
    best = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id"))).alias("t"))
    return _sized(rows, least).join(best, "cluster").select("cluster_id", "size", F.transform("t", lambda x: x["vec_id"]).alias("typical"))

"""The most similar vectors of every vector: one navigable small-world graph per shard.

Vectors are routed to cells, each the surroundings of a pivot; a cell with more vectors than a
shard holds is spread over several shards. Every shard builds its graph (hnsw.Graph) once, by
insertion, over its own vectors. What a vector is similar to is found by walking graphs: that of
its own shard and those of the cells around it; the results of all of them are merged.

What is brought to the driver and sent to every task: a sample of at most `sample` vectors, the
at most `max_pivots` pivots fitted to it, and the sizes of their cells. Copies of one vector are
reduced to the one with the smallest id before anything is shared out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import require, written
from tilewright.llm.hnsw import Graph


@dataclass(frozen=True)
class Settings:
    """dim: elements of a valid vector. cell: vectors of a cell, on average. shard: vectors of a
    shard, at most. probes: cells that a query of search() meets, at least, its own among them.
    wide: share of the pivots of its region that it meets, if these are more, so that the recall
    doesn't fall as a region gets more cells. build, ef: width of the beam of insertions and of
    searches. sample: vectors that pivots are fitted to, at most. max_pivots: from cell *
    max_pivots vectors on, cells grow and are spread over more shards. block: visits of a shard
    that one task answers, at most; a shard with more is built once for each so many."""

    dim: int = 64
    cell: int = 16384
    shard: int = 32768
    probes: int = 3
    wide: float = 0.0
    build: int = 16
    ef: int = 16
    sample: int = 65536
    max_pivots: int = 4096
    block: int = 131072


def unit_rows(ids: pa.Array, spaces: pa.Array, lists: pa.Array, dim: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Ids, spaces and unit vectors (float32) of the valid rows: `dim` finite numbers, not all
    zero, with an id and a space."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    ok = (lengths == dim) & np.asarray(ids.is_valid()) & np.asarray(spaces.is_valid())
    rows = np.nonzero(ok)[0]
    chosen = lists.take(pa.array(rows)).flatten()
    x = np.asarray(chosen.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    rows, x = rows[good], x[good]
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    at = pa.array(rows)
    return np.asarray(ids.take(at), dtype=np.int64), spaces.take(at).to_pylist(), x.astype(np.float32)


def decoded(codes: pa.Array, dim: int) -> np.ndarray:
    """Vectors from their 16-bit codes, of length 1 again."""
    x = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.float16).reshape(-1, dim).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Router:
    """Cells of vectors: those of the nearest pivots of their space. A space without pivot is one
    cell, -1."""

    def __init__(self, pivots: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.pivots = pivots

    def own(self, space: str, x: np.ndarray) -> np.ndarray:
        """Each vector's own cell."""
        if space not in self.pivots:
            return np.full(len(x), -1, dtype=np.int32)
        numbers, base = self.pivots[space]
        return np.concatenate([numbers[np.argmax(x[at : at + 4096] @ base.T, axis=1)] for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, dtype=np.int32)

    def close(self, space: str, x: np.ndarray, margin: float) -> list[list[int]]:
        """Each vector's cells, its own first: those from which a plane in the middle of two pivots
        parts it by at most `margin`. Of two vectors at a distance of 2 * margin at most, one
        meets the other's cell."""
        if space not in self.pivots:
            return [[-1]] * len(x)
        numbers, base = self.pivots[space]
        apart = np.sqrt(np.maximum(2 - 2 * base @ base.T, 1e-12)).astype(np.float32)
        out: list[list[int]] = []
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ base.T
            own = np.argmax(s, axis=1)
            near = s[np.arange(len(s)), own][:, None] - s <= margin * apart[own]
            near[np.arange(len(s)), own] = False
            cells = [[int(numbers[o])] for o in own]
            for r, c in zip(*np.nonzero(near)):
                cells[r].append(int(numbers[c]))
            out += cells
        return out

    def around(self, space: str, x: np.ndarray, probes: int, wide: float) -> list[list[int]]:
        """Each vector's cells, its own first: those of the `probes` nearest pivots, or of the share
        `wide` of its region, which are the pivots at least half as similar as the nearest."""
        if space not in self.pivots:
            return [[-1]] * len(x)
        numbers, base = self.pivots[space]
        out = []
        for at in range(0, len(x), 1024):
            s = x[at : at + 1024] @ base.T
            region = (s >= s.max(axis=1, keepdims=True) / 2).sum(axis=1)
            p = np.minimum(np.maximum(probes, np.ceil(wide * region).astype(int)), len(numbers))
            order = np.argsort(-s, axis=1, kind="stable")
            out += [numbers[o[:n]].tolist() for o, n in zip(order, p)]
        return out


ROUTED = "vec_id bigint, space string, key bigint, cells array<int>, code binary, asks boolean"


def routed(vectors: DataFrame, settings: Settings, router: Router, margin: float | None = None, queries: Column | None = None) -> DataFrame:
    """vectors (vec_id, space, features) -> the valid ones, with a key of their content, their
    code, whether they ask, and their cells: the own one, and if they ask those to be met."""
    given = vectors.sparkSession.sparkContext.broadcast(router)
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids, spaces, x = unit_rows(batch.column(0), batch.column(1), batch.column(2), s.dim)
            whole = dict(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()))  # asks follows from the id
            asking = np.array([bool(whole[i]) for i in ids.tolist()], dtype=bool)
            raw = x.astype(np.float16).tobytes()
            step = 2 * s.dim
            codes = [raw[i : i + step] for i in range(0, len(raw), step)]
            keys = np.fromiter((xxhash.xxh64_intdigest(c) for c in codes), dtype=np.uint64, count=len(codes)).view(np.int64)
            cells: list = [None] * len(ids)
            names = np.array(spaces, dtype=object)
            for space in set(spaces):
                for flag in (False, True):
                    at = np.nonzero((names == space) & (asking == flag))[0]
                    if not flag:
                        met = given.value.own(space, x[at])[:, None].tolist()
                    elif margin is None:
                        met = given.value.around(space, x[at], s.probes, s.wide)
                    else:
                        met = given.value.close(space, x[at], margin)
                    for i, c in zip(at, met):
                        cells[i] = c
            yield pa.record_batch(
                [pa.array(ids), pa.array(spaces, pa.string()), pa.array(keys), pa.array(cells, pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(asking)],
                names=["vec_id", "space", "key", "cells", "code", "asks"],
            )

    asks = F.lit(True) if queries is None else queries
    return vectors.select("vec_id", "space", "features", asks.alias("asks")).mapInArrow(run, ROUTED)


def fitted(x: np.ndarray, k: int, passes: int = 10) -> np.ndarray:
    """k pivots for unit vectors, in an order that follows from theirs: spherical k-means from
    k of them; a pivot that loses all of its vectors goes to the one that is worst off."""
    base = x[:k].copy()
    for _ in range(passes):
        own, like = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.float32)
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ base.T
            own[at : at + 4096], like[at : at + 4096] = np.argmax(s, axis=1), s.max(axis=1)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, own, x)
        length = np.sqrt((sums**2).sum(axis=1))
        lost = np.nonzero(length < 1e-9)[0]
        base = (sums / np.maximum(length, 1e-9)[:, None]).astype(np.float32)
        base[lost] = x[np.argsort(like, kind="stable")[: len(lost)]]
    return base


def pivots(vectors: DataFrame, settings: Settings) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """One pivot for about `cell` vectors, max_pivots at most, shared out by the number of each
    space's vectors in a sample that follows from the ids (see Settings)."""
    s = settings
    n = vectors.count()
    if not n:
        return {}
    wanted = min(s.max_pivots, max(1, n // s.cell))
    size = min(s.sample, max(1024, 256 * wanted))
    share = min(1.0, 1.2 * size / n)
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(77)), F.lit(1 << 40))
    sample = vectors.where(drawn < int(share * (1 << 40)))
    rows = routed(sample, s, Router({})).select("space", "key", "vec_id", "code", F.xxhash64("vec_id", F.lit(78)).alias("h"))
    rows = rows.groupBy("space", "key").agg(F.min(F.struct("h", "vec_id", "code")).alias("v")).select("space", "v.*").orderBy("h", "vec_id").limit(size).collect()
    out, number = {}, 0
    for space in sorted({r["space"] for r in rows}):
        x = decoded(pa.array([bytes(r["code"]) for r in rows if r["space"] == space], pa.binary()), s.dim)
        k = max(1, round(wanted * len(x) / len(rows)))
        out[space] = (np.arange(number, number + k, dtype=np.int32), fitted(x, k))
        number += k
    return out


@dataclass
class Index:
    """What a search starts from: the routed vectors, written; repeated: classes (space, key, rep,
    last) of rows with equal vectors; small: whether these are few enough to be sent to every task."""

    rows: DataFrame
    settings: Settings
    router: Router
    repeated: DataFrame
    small: bool


#: Classes of repeated vectors that are sent to every task; more are joined by a shuffle.
SMALL = 200_000


def index(vectors: DataFrame, settings: Settings = Settings(), margin: float | None = None, queries: Column | None = None) -> Index:
    """vectors: vec_id, space, features. queries as in search(); margin as in Router.close()."""
    require(vectors, "vec_id", "space", "features")
    router = Router(pivots(vectors, settings))
    rows = written(routed(vectors, settings, router, margin, queries), "routed")
    classes = rows.groupBy("space", "key").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"), F.count("*").alias("n"))
    repeated = written(classes.where("n > 1").select("space", "key", "rep", "last"), "classes")
    return Index(rows, settings, router, repeated, repeated.limit(SMALL + 1).count() <= SMALL)


FOUND = "space string, vec_id bigint, neighbour bigint, similarity float"


def search(ix: Index, k: int, at_least: float | None = None) -> DataFrame:
    """(space, vec_id, neighbour, similarity) of the vectors that ask: what the graphs they met
    have found.

    Without at_least: the k nearest in each shard that a vector met. With it: all that are at
    least so similar; k is no cap, a beam that is filled is widened (Graph.within), and a pair
    comes up in one order, perhaps from several shards. All vectors must ask then.
    """
    s, pairs = ix.settings, at_least is not None
    few = ix.repeated.select("space", "key", "rep")
    rows = ix.rows.join(F.broadcast(few) if ix.small else few, ["space", "key"], "left")
    # a class asks if any member does; its cells are those of a member that asks
    again = rows.where("rep IS NOT NULL").groupBy("space", "key", F.col("rep").alias("vec_id")).agg(F.max_by("cells", F.size("cells")).alias("cells"), F.first("code").alias("code"), F.bool_or("asks").alias("asks"))
    one = rows.where("rep IS NULL").select("space", "key", "vec_id", "cells", "code", "asks").unionByName(again)
    met = one.select("space", F.posexplode("cells").alias("rank", "cell"))
    loads = met.groupBy("space", "cell").agg(F.count_if(F.col("rank") == 0).alias("own"), F.count("*").alias("met"))
    loads = loads.select("space", "cell", F.greatest(F.lit(1), F.ceil(F.col("own") / s.shard)).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("met") / s.block)).cast("int").alias("blocks"))
    spread = one.select("space", "key", "vec_id", "code", "asks", F.posexplode("cells").alias("rank", "cell"))
    spread = spread.join(F.broadcast(loads), ["space", "cell"])  # at most one row per pivot and space
    home = F.pmod("key", "shards")
    # of two vectors of a cell that is spread, the one of the lower shard visits the other's
    first = F.when((F.col("rank") == 0) & F.lit(pairs) | ~F.col("asks"), home).otherwise(F.lit(0)).cast("int")
    last = F.when(F.col("asks"), F.col("shards") - 1).otherwise(home).cast("int")
    spread = spread.select("*", F.explode(F.sequence(first, last)).alias("shard"))
    spread = spread.withColumn("member", (F.col("rank") == 0) & (F.col("shard") == home))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    spread = spread.withColumn("block", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    spread = spread.select("space", "cell", "shard", "block", "vec_id", "member", (F.col("asks") & ((~F.col("member")) | (F.col("block") == 0))).alias("asks"), "code")

    def solve(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        member = np.asarray(table.column("member").combine_chunks())
        asking = np.asarray(table.column("asks").combine_chunks())
        x = decoded(table.column("code"), s.dim)
        own = np.nonzero(member)[0]
        _, first = np.unique(ids[own], return_index=True)
        own = own[first]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(asked: np.ndarray, r: np.ndarray, places: np.ndarray, sims: np.ndarray) -> None:
            a, b = ids[asked[r]], ids[own[places]]
            other = a != b
            out.append((a[other], b[other], sims[other]))

        if len(own):
            graph = Graph(x[own], ids[own], s.build)
            mine, others = np.nonzero(asking[own])[0], np.nonzero(asking & ~member)[0]
            if pairs:  # each pair was met when the later of the two was inserted
                full = (graph.sims >= at_least).all(axis=1)
                r, c = np.nonzero((graph.sims >= at_least) & ~full[:, None])
                found(own, r, graph.near[r, c], graph.sims[r, c])
                for asked, q in ((own[full], x[own[full]]), (others, x[others])):
                    found(asked, *graph.within(q, at_least, s.ef))
            else:
                for asked, extra in ((own[mine], 1), (others, 0)):
                    places, sims = graph.search(x[asked], k + extra, max(k + extra, s.ef))
                    r, c = np.nonzero(places >= 0)
                    found(asked, r, places[r, c], sims[r, c])
        a, b, v = (np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float32)))
        space = table.column("space")[0].as_py()
        return pa.table({"space": pa.array([space] * len(a), pa.string()), "vec_id": pa.array(a, pa.int64()), "neighbour": pa.array(b, pa.int64()), "similarity": pa.array(v, pa.float32())})

    return spread.groupBy("space", "cell", "shard", "block").applyInArrow(solve, FOUND)


def members(ix: Index) -> DataFrame:
    """(space, rep, vec_id, asks): the classes of vectors that several ids have."""
    several = ix.repeated.where("last > rep").select("space", "key", "rep")
    return ix.rows.select("space", "key", "vec_id", "asks").join(F.broadcast(several) if ix.small else several, ["space", "key"]).select("space", "rep", "vec_id", "asks").distinct()


def similar_pairs(vectors: DataFrame, at_least: float, settings: Settings = Settings(), expand: int = 32) -> DataFrame:
    """(space, vec_id_a, vec_id_b, similarity), the smaller id first: pairs of different vectors
    of one space whose cosine similarity is at least the given one.

    Up to the loss of the graphs; routing loses nothing, since a vector meets every cell whose
    border is within half the distance that two such vectors can have. Copies of a vector form
    a class; if it has at most `expand` members, they stand in for each other in all pairs, else
    each of them is paired with the one of smallest id, which has the class's links. copies()
    tells the members of all classes, from which the other pairs follow.

    Rows that are not valid (see unit_rows) have no pairs; repeats count once; an empty table
    gives no rows; other columns are ignored.
    """
    ix = index(vectors, settings, margin=float(np.sqrt(max(0.0, 2 - 2 * at_least)) / 2))
    found = search(ix, 1, at_least)
    links = found.select("space", F.least("vec_id", "neighbour").alias("a"), F.greatest("vec_id", "neighbour").alias("b"), "similarity")
    links = links.groupBy("space", "a", "b").agg(F.max("similarity").alias("similarity"))
    if ix.repeated.where("last > rep").isEmpty():
        return links.select("space", F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"), "similarity")
    same = written(members(ix).select("space", "rep", "vec_id"), "members")
    few = same.groupBy("space", "rep").agg(F.count("*").alias("m")).where(F.col("m") <= expand).join(same, ["space", "rep"]).select("space", "rep", "vec_id")
    one = few.select("space", F.col("rep").alias("a"), F.col("vec_id").alias("x"))
    two = few.select("space", F.col("rep").alias("b"), F.col("vec_id").alias("y"))
    between = links.join(one, ["space", "a"], "left").join(two, ["space", "b"], "left")
    between = between.select("space", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "similarity")
    star = same.where("vec_id <> rep").select("space", F.col("rep").alias("x"), F.col("vec_id").alias("y"), F.lit(1.0).cast("float").alias("similarity"))
    inner = few.alias("l").join(few.alias("r"), ["space", "rep"]).where("l.vec_id < r.vec_id").select("space", F.col("l.vec_id").alias("x"), F.col("r.vec_id").alias("y"), F.lit(1.0).cast("float").alias("similarity"))
    every = between.unionByName(star).unionByName(inner)
    return every.groupBy("space", F.least("x", "y").alias("vec_id_a"), F.greatest("x", "y").alias("vec_id_b")).agg(F.max("similarity").alias("similarity"))


def copies(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(space, vec_id, representative): the vectors that several ids have, each with the smallest
    of these ids; cases as in similar_pairs()."""
    require(vectors, "vec_id", "space", "features")
    rows = routed(vectors, settings, Router({})).select("space", "key", "vec_id")
    classes = rows.groupBy("space", "key").agg(F.min("vec_id").alias("representative"), F.max("vec_id").alias("last")).where("last > representative")
    return rows.join(classes, ["space", "key"]).select("space", "vec_id", "representative").distinct()


def most_similar(vectors: DataFrame, k: int = 10, settings: Settings = Settings(), queries: Column | None = None) -> DataFrame:
    """(space, vec_id, rank, neighbour, similarity): the k most similar vectors of every vector,
    or of those for which `queries` holds; of equal similarities the smaller id first.

    Copies of a vector form a class: a copy for which `queries` holds has the neighbours of its
    representative, the one of smallest id; neighbours are representatives. Every other member
    of a class that occurs, as the asking one or as a neighbour, has a row with its
    representative at rank 0. Cases as in similar_pairs().
    """
    ix = index(vectors, settings, queries=queries)
    found = search(ix, k).groupBy("space", "vec_id", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = "row_number() OVER (PARTITION BY space, vec_id ORDER BY similarity DESC, neighbour)"
    ranked = written(found.withColumn("rank", F.expr(order)).where(F.col("rank") <= k).select("space", "vec_id", "rank", "neighbour", "similarity"), "ranked")
    asks = F.lit(True) if queries is None else queries
    if ix.repeated.where("last > rep").isEmpty():
        return ranked.where(asks)
    copied = written(members(ix).where("vec_id <> rep"), "copies")
    own = copied.where("asks").join(ranked.withColumnRenamed("vec_id", "rep"), ["space", "rep"]).select("space", "vec_id", "rank", "neighbour", "similarity")
    met = ranked.where(asks).select("space", F.col("vec_id").alias("rep")).unionByName(own.select("space", F.col("neighbour").alias("rep")))
    met = met.unionByName(ranked.where(asks).select("space", F.col("neighbour").alias("rep"))).unionByName(copied.where("asks").select("space", "rep")).distinct()
    held = copied.join(met, ["space", "rep"]).select("space", "vec_id", F.lit(0).alias("rank"), F.col("rep").alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))
    return ranked.where(asks).unionByName(own).unionByName(held)

"""Graphs find what brute force finds; copies have the neighbours of their class; odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import hnsw, neighbours

SCHEMA = "vec_id long, space string, features array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grouped(n, groups, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = unit(rng.normal(size=(groups, 64)))
    return unit(centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 64)) / 8).astype(np.float32)


def test_graph_recall():
    x = grouped(6000, 5, 1)
    graph = hnsw.Graph(x, np.arange(6000))
    s = x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -2
    want = np.argpartition(-s, 10, axis=1)[:, :10]
    found, _ = graph.search(x[:300], 11, 128)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), want.tolist())]) >= 0.9


def test_insertion_meets_near_pairs():
    x = grouped(5000, 3, 2)
    x[2500:2800] = unit(x[:300] + 0.01 * np.random.default_rng(3).normal(size=(300, 64))).astype(np.float32)
    graph = hnsw.Graph(x, np.arange(5000))
    r, c = np.nonzero(graph.sims >= 0.98)
    got = {tuple(sorted(p)) for p in zip(r.tolist(), graph.near[r, c].tolist())}
    want = {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= 0.98, 1)).tolist()}
    assert len(got & want) >= 0.98 * len(want) and got <= want


def test_no_cap_on_partners(spark):
    x = np.ones(64) + 0.02 * np.random.default_rng(4).normal(size=(150, 64))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    assert neighbours.similar_pairs(df, 0.98).count() == 150 * 149 // 2


def test_spread_cells_lose_no_pair(spark):
    x = grouped(1200, 2, 5)
    x[600:700] = unit(x[:100] + 0.008 * np.random.default_rng(6).normal(size=(100, 64)))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    want = {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= 0.98, 1)).tolist()}
    for settings in (neighbours.Settings(cell=100, shard=40, block=90), neighbours.Settings()):
        got = {(r[0], r[1]) for r in neighbours.similar_pairs(df, 0.98, settings).select("vec_id_a", "vec_id_b").collect()}
        assert got == want


def test_odd_rows_and_clashing_columns(spark):
    one = [1.0] * 64
    rows = [(1, "a", one), (1, "a", one), (2, "a", [2.0] * 64), (3, "b", one), (4, "a", None), (5, "a", []), (6, "a", [0.0] * 64), (7, "a", [float("nan")] * 64), (8, None, one), (None, "a", one), (9, "a", [1.0] * 63)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("asks", F.lit(False))
    assert [(r[1], r[2]) for r in neighbours.similar_pairs(df, 0.98).collect()] == [(1, 2)]
    assert {(r[1], r[2]) for r in neighbours.copies(df).collect()} == {(1, 1), (2, 1)}
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.similar_pairs(empty, 0.98).count() == 0 and neighbours.most_similar(empty).count() == 0


def test_large_classes_are_paired_with_the_smallest(spark):
    df = spark.createDataFrame([(i, "a", [1.0] * 64) for i in range(40)], SCHEMA)
    assert {(r[1], r[2]) for r in neighbours.similar_pairs(df, 0.98).collect()} == {(0, i) for i in range(1, 40)}


def test_copy_that_asks(spark):
    x = np.random.default_rng(1).normal(size=(30, 64)).astype(float)
    rows = [(i, "a", x[i].tolist()) for i in range(1, 30)] + [(100, "a", x[7].tolist()), (31, "a", x[7].tolist())]
    got = neighbours.most_similar(spark.createDataFrame(rows, "vec_id long, space string, features array<double>"), 3, neighbours.Settings(probes=32), queries=F.pmod("vec_id", F.lit(100)) == 0).collect()
    mine = sorted((r["rank"], r["neighbour"]) for r in got if r["vec_id"] == 100)
    u = unit(x)
    s = u @ u[7]
    s[[0, 7]] = -2
    assert mine == [(0, 7), *((i + 1, int(j)) for i, j in enumerate(np.argsort(-s)[:3]))]
    assert [(r["rank"], r["neighbour"]) for r in got if r["vec_id"] == 31] == [(0, 7)]
    assert not [r for r in got if r["vec_id"] == 7]


def test_probes_follow_the_region():
    base = np.ones((300, 64), dtype=np.float32) / 8
    router = neighbours.Router({"a": (np.arange(300, dtype=np.int32), base)})
    assert len(router.around("a", base[:1], 24, 0.5)[0]) == 150


@pytest.mark.parametrize("cell", [60, 100_000])
def test_recall_where_cells_outnumber_probes(spark, cell):
    x = grouped(6000, 40, 7, 0.4)
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    settings = neighbours.Settings(cell=cell, probes=5, ef=64, wide=0.5)
    got = neighbours.most_similar(df, 10, settings, F.pmod("vec_id", F.lit(100)) == 0).collect()
    s = x[::100] @ x.T
    s[np.arange(60), np.arange(60) * 100] = -2
    want = {(i * 100, int(j)) for i, row in enumerate(np.argpartition(-s, 10, axis=1)[:, :10]) for j in row}
    assert len(want & {(r["vec_id"], r["neighbour"]) for r in got}) / len(want) >= 0.9

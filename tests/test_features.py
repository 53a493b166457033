"""Pooling, ranks and measures against direct computation; ties, nulls and hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import encoders, pooling, ranking

SCHEMA = "k string, vec_id long, features array<double>, coords array<long>"


def vectors(spark, n=60, dim=4):
    x = np.random.default_rng(1).normal(size=(n, dim))
    rows = [("hot" if i % 3 else None if i % 2 else "b", i, v.tolist(), [i, 0]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), x


def by_key(x):
    keys = ["hot" if i % 3 else None if i % 2 else "b" for i in range(len(x))]
    return {k: [i for i in range(len(x)) if keys[i] == k] for k in set(keys)}


def test_means(spark):
    df, x = vectors(spark)
    want = {k: x[i].mean(axis=0) for k, i in by_key(x).items()}
    bad = df.unionByName(spark.createDataFrame([("b", 99, None, None), ("b", 98, [1.0], None)], SCHEMA))
    for r in pooling.mean_vectors(bad, ["k"], 4).collect():
        assert np.allclose(r["features"], want[r["k"]])
    for r in pooling.mean_pool(df, ["k"]).collect():
        assert np.isclose(r["mean"], want[r["k"]][r["i"] - 1])
    assert pooling.mean_vectors(df.limit(0), ["k"], 4).count() == 0


def test_attention_and_softmax(spark):
    df, x = vectors(spark)
    df, model = df.where("k IS NOT NULL"), pooling.Attention(4, 3, heads=2, seed=5)
    for k, at in by_key(x).items():
        if k is None:
            continue
        s = model.scores(x[at])
        w = np.exp(s - s.max(axis=1, keepdims=True))
        want = np.concatenate([wi @ x[at] / wi.sum() for wi in w])
        for parts in (1, 7):
            got = {r["i"]: r["v"] for r in pooling.attention_pool(df.repartition(parts), ["k"], model).where(F.col("k") == k).collect()}
            assert np.allclose([got[i + 1] for i in range(8)], want)
        w = np.exp(np.array(at) / 10.0)
        got = {r["i"]: r["v"] for r in pooling.softmax_pool(df.withColumn("s", F.col("vec_id") / 10), ["k"], "s").where(F.col("k") == k).collect()}
        assert np.allclose([got[i + 1] for i in range(4)], w @ x[at] / w.sum())


def test_own_slide_encoder(spark):
    df, x = vectors(spark)
    got = pooling.slide_encoder(df.where("k = 'hot'"), ["k"], lambda f, c: np.concatenate([f[0], c[-1]]), order="vec_id").first()
    at = by_key(x)["hot"]
    assert np.allclose(got["features"], [*x[at[0]], at[-1], 0])


def test_cosine_topk(spark):
    df, x = vectors(spark)
    rows = df.select("vec_id", F.col("k").alias("part"), "features")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 3):
        got = {(r["query"], r["rank"]): r["vec_id"] for r in pooling.cosine_topk(rows, rows.where("vec_id < 10"), 3, 4, block=block).collect()}
        for q in range(10):
            s = np.round(u @ u[q], 6)
            s[q] = -9
            assert [got[q, r + 1] for r in range(3)] == np.lexsort((np.arange(len(s)), -s))[:3].tolist()
    assert pooling.cosine_topk(rows, rows.limit(0), 3, 4).count() == 0


def test_valid(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],), ([1.0, None],), ([float("inf"), 1.0],)]
    assert [r[0] for r in spark.createDataFrame(rows, "f array<double>").select(pooling.valid(F.col("f"), 2)).collect()] == [True] + [False] * 6


def test_ranks_of_ties_nulls_and_hot_keys(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), (None, 5.0)] + [("hot", float(i // 2)) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.rank_normalised(spark.createDataFrame(rows, "k string, s double"), "k", "s").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r["s"] or 0, r["rank"]) for r in got if r["k"] == "a") == [(0, None), (1.0, 1 / 3), (3.0, 2.5 / 3), (3.0, 2.5 / 3)]
    assert [r["rank"] for r in got if r["k"] is None] == [0.75, 0.75]
    assert all(abs(r["rank"] - (2 * r["s"] + 1.5) / 400) < 1e-12 for r in got if r["k"] == "hot")
    assert ranking.rank_normalised(spark.createDataFrame([], "k string, s double"), "k", "s").count() == 0


def test_numbered(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranking.numbered(spark.range(1000).repartition(7).withColumn("__x", F.lit(1)), ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r["row"] == r["id"] for r in rows) and len(rows) == 1000
    got = ranking.shards(spark.range(10), ["id"], 3, 4).collect()
    assert [(r["shard"], r["batch"]) for r in sorted(got)] == [(i % 3, i // 4) for i in range(10)]


def test_heatmap_and_top(spark):
    rows = [("s", 0, 0, 10, 1.0, 1), ("s", 5, 0, 10, 0.0, 2), ("s", 5, 0, 10, None, 3), ("s", None, 0, 10, 9.0, 4), ("t", 0, 0, 10, 0.5, 5)]
    df = spark.createDataFrame(rows, "sid string, x long, y long, ps long, score double, patch_id long")
    got = {(r["sid"], r["cx"], r["cy"]): (r["score"], r["n"]) for r in ranking.heatmap(df, 0.1).collect()}
    assert got == {("s", 0, 0): (1.0, 1), ("s", 1, 0): (0.0, 1), ("t", 0, 0): (0.5, 1)}
    assert ranking.heatmap(df, 0.1, cells=1).count() == 2
    top = {(r["sid"], r["patch_id"]): (r["rank_desc"], r["file_no"]) for r in ranking.top_patches(df, "sid", "score", "patch_id", 2).collect()}
    assert top == {("s", 4): (1, 1), ("s", 1): (2, 0), ("t", 5): (1, 0)}


def test_subsample(spark):
    df = spark.range(30).select("id", F.when(F.col("id") < 27, "big").otherwise("small").alias("k"))
    got = ranking.subsample(df, "k", "id", 10).collect()
    of = lambda k: [r["id"] for r in got if r["k"] == k]
    assert len(of("big")) == len(set(of("big"))) == 10 and len(of("small")) == 10 and {of("small").count(i) for i in (27, 28, 29)} <= {3, 4}
    assert sorted(map(tuple, got)) == sorted(map(tuple, ranking.subsample(df.repartition(9), "k", "id", 10).collect()))


def test_measures(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.6, 0), ("a", 0.6, 1), ("a", 0.1, 0), ("b", 0.5, 1), ("b", None, 1)], "k string, s double, y int")
    got = {r["k"]: (r["n"], r["auc"], r["accuracy"]) for r in ranking.auc(df, "k", "s", "y").collect()}
    assert got == {"a": (4, 0.875, 0.75), "b": (1, None, 1.0)}
    same = spark.createDataFrame([(i % 3, (i % 3) * 2) for i in range(12)], "a int, b int")
    assert ranking.agreement(same, "a", "b").first()["ari"] == 1.0


def test_encoders(spark):
    tiles = spark.createDataFrame([("a", 1, 8, 8, bytes([10, 20, 30] * 64)), ("b", 2, 8, 8, None), ("c", 3, 9, 8, b"x"), ("d", 4, 16, 8, bytes([40, 50, 60] * 128))], "sid string, patch_idx int, h int, w int, pixels binary")
    got = {r["sid"]: r["features"] for r in encoders.encoded(tiles, encoders.mean_rgb(), ["sid", "patch_idx"], batch=1).collect()}
    assert got == {"a": [10, 20, 30], "b": None, "c": None, "d": [40, 50, 60]}

    def fail(x):
        raise AssertionError("called")

    assert encoders.encoded(tiles.limit(0), encoders.Encoder("f", 3, fail), ["sid"]).count() == 0
    for name, message in (("uni_v1", "weights"), ("nothing", "unknown")):
        with pytest.raises(ValueError, match=message):
            encoders.encoder(name)
    assert encoders.slide_encoder_input("mean-kaiko-vits8") == "kaiko-vits8" and encoders.slide_encoder_input("titan") == "conch_v15"
    assert encoders.registry(spark).where("kind = 'patch' AND NOT available").count() == 29
    tokens = F.array(*[F.array(F.lit(float(i)), F.lit(float(-i))) for i in range(4)])
    assert spark.range(1).select(encoders.cls_and_mean(tokens, 2)).first()[0] == [0.0, -0.0, 2.5, -2.5]
    with pytest.raises(ValueError, match="normalisation"):
        encoders.normalised(np.zeros((1, 2, 2, 3)), "none such")
    with pytest.raises(Exception, match="multiple"):
        spark.range(1).select(encoders.checked_size(F.lit(225), 16)).collect()
    assert encoders.histogram().encode(np.zeros((2, 4, 4, 3), np.uint8)).sum() == 6 and encoders.centre_crop(np.zeros((1, 4, 6, 3)), 2).shape == (1, 2, 2, 3)


def test_neighbours_and_places_over_ranges(spark):
    rows = [(None if i % 10 == 9 else "hot" if i % 10 else f"k{i}", i, i * 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(6)
    keys = {}
    for k, o, v in rows:
        keys.setdefault(k, []).append((o, v))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = {r["o"]: (r["__before"] and r["__before"]["v"], r["__after"] and r["__after"]["v"]) for r in ranking.with_neighbours(df, ["k"], ["o"], ["v"]).collect()}
        places = {r["o"]: r["n"] for r in ranking.numbered_by(df, ["k"], ["o"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for own in keys.values():
        for i, (o, _) in enumerate(own):
            assert near[o] == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None) and places[o] == i + 1

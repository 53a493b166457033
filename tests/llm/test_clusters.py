"""Markov clustering: known answers, the same groups however the rows are shared out, odd rows."""

import time

import numpy as np
from pyspark.sql import functions as F

from tilewright.llm import clusters

SCHEMA = "vec_id long, space string, features array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_two_cliques_and_a_weak_bridge():
    pairs = [(i, j, 1.0) for c in (range(5), range(5, 10)) for i in c for j in c if i < j] + [(4, 5, 0.2)]
    a, b, v = (np.array(x) for x in zip(*pairs))
    both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
    to, flow = clusters.markov(10, *both, clusters.Settings(), 2.0)
    assert len({*to[:5]}) == 1 and len({*to[5:]}) == 1 and to[0] != to[9]
    assert abs(flow.sum() - 10) < 1e-5


def columns(rng, n, most):
    """Columns of 1 to `most` entries, on their left."""
    rows, values = np.full((n, 6), -1, dtype=np.int32), np.zeros((n, 6), dtype=np.float32)
    for j, k in enumerate(rng.integers(1, most + 1, n)):
        rows[j, :k], values[j, :k] = rng.choice(n, k, replace=False), rng.random(k) + 0.1
    return rows, values / values.sum(axis=1, keepdims=True)


def test_squared_is_the_matrix_squared_inflated_and_pruned():
    rng = np.random.default_rng(10)
    for n, most, prune in ((9000, 6, 1e-3), (700, 6, 0.05), (700, 6, 0.9), (300, 2, 1e-3), (300, 1, 1e-3)):
        rows, values = columns(rng, n, most)
        got_rows, got, flow = clusters._squared(rows, values, 2.0, prune, 6)
        want_flow = np.zeros(n)
        for j in range(n):
            column = np.zeros(n)
            for k, y in zip(rows[j], values[j]):
                some = rows[k] >= 0
                column[rows[k][some]] += (y > 0) * y * values[k][some]
            want_flow += column
            strong = column**2 / (column**2).sum()
            strong[strong < min(prune, strong.max())] = 0
            strong[np.argsort(-strong)[6:]] = 0
            want = strong / strong.sum()
            held = got_rows[j] >= 0
            assert not (np.diff(held.astype(int)) > 0).any() and set(got_rows[j][held]) == set(np.flatnonzero(want))
            assert np.abs(want[got_rows[j][held]] - got[j][held]).max() < 1e-5 and not got[j][~held].any()
        assert np.abs(flow - want_flow).max() < 1e-4


def test_columns_of_few_entries_cost_little_to_square():
    # most columns of the last squarings of a round have settled
    n, rng = 32768, np.random.default_rng(11)
    full = rng.integers(0, n, (n, 6)).astype(np.int32), np.full((n, 6), 1 / 6, dtype=np.float32)
    settled = np.full((n, 6), -1, dtype=np.int32), np.zeros((n, 6), dtype=np.float32)
    settled[0][:, 0], settled[1][:, 0] = np.arange(n) // 8, 1
    times = []
    for rows, values in (full, settled):
        spent = []
        for _ in range(5):
            began = time.thread_time()
            clusters._squared(rows, values, 2.0, 1e-3, 6)
            spent.append(time.thread_time() - began)
        times.append(min(spent))
    assert times[1] < 0.5 * times[0]


def test_block_joins_all_that_is_linked():
    n = 300
    a = np.arange(n - 1)
    to, _ = clusters.block(n, a, a + 1, np.ones(n - 1))  # a chain
    assert len(set(to.tolist())) == 1
    to, _ = clusters.block(6, np.array([0, 3]), np.array([1, 4]), np.ones(2))
    assert to[0] == to[1] and to[3] == to[4] and len(set(to.tolist())) == 4


def test_distributed_table(spark):
    pairs = [(i, j, 1.0) for c in (range(5), range(5, 10)) for i in c for j in c if i != j] + [(4, 5, 0.2), (5, 4, 0.2)]
    got = {r["node"]: r["attractor"] for r in clusters.flow(spark.createDataFrame(pairs, "i long, j long, v double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def frame(spark, x, parts):
    return spark.createDataFrame([(i, "a" if i % 2 else "b", v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(parts)


def test_same_groups_for_any_partitioning_and_sharding(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = np.linalg.qr(rng.normal(size=(64, 8)))[0].T
    own = rng.choice(8, 800, p=[0.33, 0.2, 0.15, 0.1, 0.1, 0.06, 0.04, 0.02])
    x = unit(centres[own] + 0.4 * rng.normal(size=(800, 64)) / 8).astype(np.float32)
    want = {}
    for i in range(800):
        want.setdefault((i % 2, own[i]), []).append(i)
    want = {(i, min(ids)) for ids in want.values() if len(ids) >= 5 for i in ids}
    assert {tuple(r) for r in clusters.groups(frame(spark, x, 1)).collect()} == want
    small = clusters.neighbours.Settings
    monkeypatch.setattr(clusters.neighbours, "Settings", lambda **k: small(**{"cell": 90, "shard": 40, **k}))
    assert {tuple(r) for r in clusters.groups(frame(spark, x, 7)).collect()} == want
    described = clusters.described(frame(spark, x, 3)).collect()
    assert {(r["cluster_id"], r["size"]) for r in described} == {(c, sum(1 for _, d in want if d == c)) for _, c in want}
    assert all(len(r["typical"]) == 3 and {(t, r["cluster_id"]) for t in r["typical"]} <= want for r in described)


def test_odd_rows(spark):
    one = [1.0] * 64
    rows = [(i, "a", one) for i in range(6)] + [(0, "a", one), (10, "a", None), (11, "a", []), (12, "a", [0.0] * 64), (13, None, one), (14, "a", [float("inf")] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("cluster", F.lit(1))
    assert sorted(tuple(r) for r in clusters.groups(df).collect()) == [(i, 0) for i in range(6)]
    assert clusters.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def joined(x, together=0.56):
    """The smallest place in x of each vector's component of pairs that are similar enough."""
    x = unit(np.asarray(x, dtype=np.float64))
    near, to = x @ x.T >= together, np.arange(len(x))
    while True:
        least = np.where(near, to[None, :], len(x)).min(axis=1)
        if (least == to).all():
            return to
        to = least


def expected(x, least=5):
    to = joined(x)
    size = np.bincount(to, minlength=len(x))
    return {(i, int(c)) for i, c in enumerate(to) if size[c] >= least}


def one_space(spark, x, parts=3):
    return spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(parts)


def clump(rng, centre, n, spread):
    return unit(centre + spread * rng.normal(size=(n, 64)) / 8).astype(np.float32)


def test_clusters_that_only_one_pair_of_vectors_ties(spark):
    rng = np.random.default_rng(5)
    e = np.eye(64)
    for n in (30, 300):  # compared whole, or as sets
        a, b = clump(rng, e[0], n, 0.05), clump(rng, e[1], n, 0.05)
        far = unit(np.array([np.cos(0.55) * e[0] + np.sin(0.55) * e[1], np.sin(0.55) * e[0] + np.cos(0.55) * e[1]])).astype(np.float32)
        x = np.concatenate([a, b, far[:1]])  # of clump a, 58 degrees from those of b
        assert len(set(c for _, c in expected(x))) == 2
        assert {tuple(r) for r in clusters.groups(one_space(spark, x)).collect()} == expected(x)
        x = np.concatenate([a, b, far])  # 27 degrees between them
        assert len(set(c for _, c in expected(x))) == 1
        assert {tuple(r) for r in clusters.groups(one_space(spark, x)).collect()} == expected(x)


def test_every_pair_that_meets_the_threshold_is_in_one_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    crowded = np.zeros((1500, 64), dtype=np.float32)
    crowded[:, :5] = unit(rng.normal(size=(1500, 5)))
    wide = np.concatenate([clump(rng, c, 90, 1.0) for c in unit(rng.normal(size=(12, 64)) + 0.75)])
    loose = unit(rng.normal(size=(1200, 64)) * 0.8 ** np.arange(64)).astype(np.float32)
    near = clusters.neighbours.Settings
    for x, cell in ((crowded, 16384), (loose, 16384), (wide, 90)):
        monkeypatch.setattr(clusters.neighbours, "Settings", lambda cell=cell, **k: near(**{"cell": cell, "shard": max(40, cell // 2), **k}))
        assert {tuple(r) for r in clusters.groups(one_space(spark, x)).collect()} == expected(x)


def test_pairs_beside_the_threshold(spark):
    # in each space 5 vectors and 5 at a cosine of 0.56 give or take 1e-5, which 16-bit codes can't tell
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for number, cosine in enumerate([0.56001, 0.55999] * 3):
        q = np.linalg.qr(rng.normal(size=(64, 12)))[0].T
        b = cosine * q[0] + np.sqrt(1 - cosine**2) * q[1]
        others = [unit((v + 0.3 * q[2 + i] + w * q[11])[None])[0] for v, w, k in ((q[0], 0.2, 0), (b, -0.2, 4)) for i in range(k, k + 4)]
        x = np.array([q[0], b, *others]).astype(np.float32)
        groups = expected(x)
        assert len(set(c for _, c in groups)) == (1 if cosine > 0.56 else 2)
        want |= {(100 * number + i, 100 * number + c) for i, c in groups}
        rows += [(100 * number + i, f"s{number}", v.tolist()) for i, v in enumerate(x)]
    assert {tuple(r) for r in clusters.groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_all_linked_clusters_are_found_whatever_the_clusters_are(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, nodes, want = [], [], {}
    for space in ("a", "b"):
        # clumps of which few pairs are similar enough, and some single vectors
        x = np.concatenate([clump(rng, c, 150, 0.8) for c in unit(rng.normal(size=(14, 64)) + 0.4)])
        x = np.concatenate([x] + [clump(rng, v, 1, 1.7) for v in x[:2000:50]])
        code = x.astype(np.float16)
        x = unit(code.astype(np.float64))
        own = np.concatenate([np.repeat(np.arange(14) * 150, 150), np.arange(2100, 2140)]) + (10**6 if space == "b" else 0)
        tied = {(int(own[i]), int(own[j])) for i, j in zip(*np.nonzero(x @ x.T >= 0.56)) if own[i] != own[j]}
        sets = {p for p in tied if max(p) % 10**6 < 2100}
        assert 0 < len(sets) < 14 * 13 / 2 and len(tied) > len(sets)
        least = {int(c): int(c) for c in own}
        for _ in least:
            for a, b in tied:
                least[a] = least[b] = min(least[a], least[b])
        want |= {c: m for c, m in least.items() if c != m}
        first = 10**6 if space == "b" else 0
        rows += [(space, first + i, int(c), v.tobytes()) for i, (c, v) in enumerate(zip(own, code))]
        nodes += [(space, int(c), int((own == c).sum()), x[own == c].sum(axis=0).astype(np.float32).tobytes()) for c in np.unique(own)]
    rows = spark.createDataFrame(rows, "space string, vec_id long, cluster long, code binary")
    nodes = spark.createDataFrame(nodes, "space string, cluster long, size long, total binary")
    features = [(r.vec_id, r.space, np.frombuffer(r.code, dtype=np.float16).astype(float).tolist()) for r in rows.collect()]
    vectors = spark.createDataFrame(features, SCHEMA)
    for side, block, sets in ((131072, 32768, 1024), (40, 30, 1024), (40, 500, 7)):
        monkeypatch.setattr(clusters.bridges, "SIDE", side)
        monkeypatch.setattr(clusters.bridges, "BLOCK", block)
        monkeypatch.setattr(clusters.bridges, "SETS", sets)
        assert {tuple(r) for r in clusters.bridges.bridged(rows, nodes, vectors, 0.56, 64).collect()} == set(want.items())


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 300, (120, 2))]
    least = {i: i for p in pairs for i in p}
    for _ in range(300):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = clusters.bridges.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, m) for i, m in least.items() if i != m}

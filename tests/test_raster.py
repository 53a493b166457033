"""Thresholds, components and contours on tiles with known answers."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import differences  # noqa: E402

from tilewright.operators import raster  # noqa: E402
from tilewright.plans import rasters  # noqa: E402


def tile(blob=True):
    x = np.full((128, 128, 3), 255, np.uint8)
    if blob:
        x[30:95, 30:95] = (150, 80, 120)
        x[:2], x[-2:], x[:, :2], x[:, -2:] = 0, 0, 0, 0
    return x


def test_tissue():
    mask = raster.tissue(tile())
    assert mask[40:90, 40:90].all() and not mask[:25].any() and not raster.tissue(tile(False)).any()


def test_components_and_cleaning():
    m = np.zeros((9, 9), bool)
    m[1:4, 1:4], m[2, 2], m[6, 6], m[4, 4] = True, False, True, True
    label, n = raster.components(m)
    assert n == 3 and label[1, 1] == label[3, 3] != label[4, 4]
    assert raster.without_small(m, 2).sum() == 8 and raster.filled(m, 2).sum() == 11 and raster.components(np.zeros((3, 3), bool))[1] == 0
    spiral = np.array([[1, 1, 1, 1], [0, 0, 0, 1], [1, 1, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]], bool)
    assert raster.components(spiral)[1] == 1


def test_contours_enclose_the_mask():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.random((8, 8)) < 0.6
        area = lambda r: abs((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) / 2
        assert sum(area(o) - sum(map(area, h)) for o, h in raster.contours(m)) == m.sum()


def test_segmented(spark):
    rows = [("a", 0, 0, 128, 128, tile().tobytes()), ("a", 128, 0, 128, 128, None), ("b", 0, 0, 5, 5, b"x")]
    got = [tuple(r) for r in raster.segmented(spark.createDataFrame(rows, "sid string, x long, y long, h int, w int, pixels binary")).collect()]
    assert got[0][3] == 65 * 65 and got[0][4] == 1 and got[1][3:] == (None, None) == got[2][3:]


@pytest.mark.parametrize("values", [[1.0, 1.1, 9.0, 9.1], [4.0], [0.0, 0.0, 5.0]])
def test_otsu_equals_one_array(spark, values):
    df = spark.createDataFrame([("k", v) for v in [*values, float("nan"), None]], "k string, v double")
    assert abs(raster.otsu(df, "k", "v").first()["threshold"] - raster.threshold_of(np.array(values))) < 1e-9


def test_accumulated(spark):
    df = spark.createDataFrame([("s", -1, 0, 2, 1), ("s", 0, 0, 1, 3), ("s", 0, 0, 1, 0), ("s", 0, 0, 1, None), ("s", 0, 0, 0, 1)], "sid string, x long, y long, side long, label int")
    assert {(r["mx"], r["my"]): (r["hits"], r["label"]) for r in raster.accumulated(df, 5, 1).collect()} == {(0, 0): (2, 3)}


def test_covered_equals_accumulated(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(x), int(y), int(side), int(label)) for s, x, y, side, label in zip(rng.integers(0, 3, 200), rng.integers(-5, 80, 200), rng.integers(-5, 60, 200), rng.integers(-1, 40, 200), rng.integers(0, 2, 200))]
    df = spark.createDataFrame([*rows, (7, 0, 0, 1, None), (8, 90, 0, 3, 1)], "sid long, x long, y long, side long, label int")
    for width, height in ((70, 50), (20, 9)):
        want = {(r["sid"], r["mx"], r["my"]) for r in raster.accumulated(df, width, height).where("hits > 0").collect()}
        got = {(r["sid"], r["word"] * raster.WORD + i, r["my"]) for r in raster.covered(df, width, height).collect() for i in range(raster.WORD) if r["bits"] >> i & 1}
        assert got == want
        drawn = {r["sid"]: np.frombuffer(bytes(r["mask"]), np.uint8).reshape(height, width) for r in raster.drawn(raster.covered(df, width, height), width, height).collect()}
        assert {(s, int(x), int(y)) for s, m in drawn.items() for y, x in zip(*np.nonzero(m))} == want


def test_masks_of_a_batch_are_traced_at_once(spark, monkeypatch):
    """Masks of several sizes and labels, and odd ones, each with its own numbers and scale."""
    rng = np.random.default_rng(4)
    masks = {f"m{i}": rng.integers(0, 3, (h, w)).astype(np.uint8) for i, (h, w) in enumerate([(9, 7), (9, 7), (4, 9), (9, 7), (1, 1), (6, 6)] * 4)}
    rows = [(s, *m.shape, 2.0 + len(s), m.tobytes()) for s, m in masks.items()] + [("none", 2, 2, 1.0, None), ("size", 2, 2, 1.0, b"xyz"), ("empty", 2, 2, 1.0, bytes(4))]
    df = spark.createDataFrame(rows, "sid string, h int, w int, scale double, mask binary").coalesce(1)
    area = lambda r: abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:] + r[:1]))) / 2
    found: dict = {}
    for r in raster.mask_polygons(df, most_holes=99).collect():
        found.setdefault(r["sid"], []).append((r["tissue_id"], r["label"], area(r["rings"][0]) - sum(map(area, r["rings"][1:])), len(r["rings"])))
    assert set(found) == {s for s, m in masks.items() if m.any()}
    for s, parts in found.items():
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[1] for p in parts] == sorted(p[1] for p in parts)
        for label in (1, 2):
            own = [p for p in parts if p[1] == label]
            assert sum(p[2] for p in own) == (masks[s] == label).sum() * (2 + len(s)) ** 2 and len(own) == raster.components(masks[s] == label)[1]
    calls = []
    traced = raster._outlines
    monkeypatch.setattr(raster, "_outlines", lambda m: calls.append(1) or traced(m))
    assert len(raster.contours(masks["m0"] == 1)) == raster.components(masks["m0"] == 1)[1] and len(calls) == 1  # all components in one trace


def test_mask_outlines_with_many_holes(spark, tmp_path):
    """More holes than mask_polygons() keeps by default; rows of no label, no side and no slide."""
    cells = [(1, x + 2, y, 1, 1.0) for x in range(38) for y in range(40) if not (x % 2 and y % 2)]
    cells += [(2, 0, 39, 7, 2.0), (2, 39, 39, 7, 1.0), (3, 5, 5, 3, 3.0), (4, 5, 5, 3, None), (None, 5, 5, 2, 1.0)]
    df = spark.createDataFrame(cells, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double")
    pandas = df.toPandas()
    pandas["l_suppkey"] = pandas["l_suppkey"].astype("Int64")
    pandas.to_parquet(tmp_path / "lineitem.parquet")
    more, less = differences(spark, rasters.QUERIES["mask_outlines"], rasters.SQL["mask_outlines"], str(tmp_path))
    assert not more and not less, (more, less)

"""Polygons against closed forms and against rectangles; contours and their filter."""

import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import geometry
from tilewright.operators import grid, polygons
from tilewright.plans import slides as plans

L = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], float)
TRIANGLE = np.array([(0, 0), (4, 0), (0, 4)], float)


def test_union_area_closed_forms():
    area = lambda shapes, *box: round(polygons.union_area([polygons.edges(s) for s in shapes], *box), 9)
    assert area([[L]], 0, 0, 4, 4) == 12 and area([[TRIANGLE]], 0, 0, 4, 4) == 8 and area([[TRIANGLE]], 1, 1, 3, 3) == 2
    assert area([[L], [L]], -1, -1, 9, 9) == 12 and area([[L], [TRIANGLE]], 0, 0, 4, 4) == 12
    assert area([[L, L * 0.25]], 0, 0, 4, 4) == 12 - 0.75 and area([], 0, 0, 1, 1) == 0 and area([[L]], 1, 1, 1.5, 1.5) == 0.25 and area([[L]], 3, 3, 4, 4) == 0


@given(st.lists(st.tuples(*[st.integers(0, 20)] * 4), max_size=5))
def test_union_of_rectangles(boxes):
    mask = np.zeros((12, 12), bool)
    shapes = []
    for a, b, c, d in boxes:
        x0, x1, y0, y1 = min(a, b), max(a, b), min(c, d), max(c, d)
        shapes.append(polygons.edges([np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)]))
        mask[max(0, y0 - 4) : max(0, y1 - 4), max(0, x0 - 4) : max(0, x1 - 4)] = True
    assert abs(polygons.union_area(shapes, 4, 4, 16, 16) - mask.sum()) < 1e-6


@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=7), max_size=4), st.lists(st.tuples(*[st.integers(0, 20)] * 2), min_size=1, max_size=5))
def test_areas_of_many_boxes(shapes, corners):
    """At once as one by one, for rings that cross themselves and each other too."""
    sides = [polygons.edges([np.array(r, float)]) for r in shapes]
    boxes = np.array([(x, y, x + 7, y + 6) for x, y in corners], float)
    assert np.allclose(polygons.union_areas(sides, boxes), [polygons.union_area(sides, *b) for b in boxes], atol=1e-6)


def test_patches_are_cut_at_once(spark, monkeypatch):
    """No patch alone for a few sides, no table to all tasks, and the rows of rectangles."""
    query = plans.QUERIES["tissue_polygons"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in query._jdf.queryExecution().executedPlan().toString()
    boxes = np.array([(x, y, x + 100, y + 100) for x in range(0, 20000, 100) for y in range(0, 1000, 100)], float)
    began = time.process_time()
    polygons.union_areas([polygons.edges([L * 700])], boxes)
    assert time.process_time() - began < 0.1  # one by one takes longer


def test_touches():
    e = [polygons.edges([TRIANGLE])]
    assert polygons.touches(e, 4, 0, 5, 1) and polygons.touches(e, 2, 2, 3, 3) and polygons.touches(e, 1, 1, 1.1, 1.1) and polygons.touches(e, -9, -9, 9, 9)
    assert not polygons.touches(e, 2.1, 2.1, 3, 3) and not polygons.touches([], 0, 0, 1, 1)


def test_simplified_and_repaired():
    ring = np.array([(0, 0), (2, 0.1), (4, 0), (4, 4), (0, 4)], float)
    assert len(polygons.simplified(ring, 0.5)) == 4 and len(polygons.simplified(ring, 0.01)) == 5 and len(polygons.simplified(TRIANGLE, 9)) == 3
    assert len(polygons.repaired(np.array([(0, 0), (0, 0), (4, 0), (6, 0), (4, 0), (0, 4)], float))) == 3
    assert polygons.repaired(np.array([(0, 0), (1, 1), (2, 2)], float)) is None


def test_expressions(spark):
    ring = lambda r: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r])
    row = spark.range(1).select(geometry.area(ring(L)), geometry.area(ring(L[:2])), geometry.net_area(ring(L), F.array(ring(TRIANGLE * 0.5))), geometry.scaled(ring([(-1.9, 1.9)]), F.lit(1.0))).first()
    assert row[0] == 12 and row[1] == 0 and row[2] == 10 and tuple(row[3][0]) == (-1, 1)


def test_semi_join_with_holes_and_odd_rows(spark):
    g = grid.patches(spark.createDataFrame([(1, 400, 400, 0.5), (2, 400, 400, 0.5)], "sid long, w long, h long, mpp double"), 100, 20).withColumn("rings", F.lit("x"))
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, 0, [ring(0.0, 400.0), ring(100.0, 300.0)]), (1, 1, None), (1, 2, []), (1, 3, [[(1.0, 1.0)]])]
    tissue = spark.createDataFrame(rows, f"sid long, tissue_id int, rings {polygons.RINGS}")
    assert polygons.on_polygons(g, tissue, 0.5, tile=2).count() == 12 and polygons.on_polygons(g, tissue, 0.0).count() == 16
    kept = polygons.on_polygons(g, tissue, 0.5, tile=1)
    assert kept.columns == g.columns and {r["sid"] for r in kept.collect()} == {1}
    assert polygons.on_polygons(g, tissue.limit(0)).count() == 0 and polygons.on_polygons(g.limit(0), tissue).count() == 0


def test_contours(spark):
    rows = [(1, 0, -1, 100.0), (1, 1, 0, 30.0), (1, 2, 0, 30.0), (1, 3, 0, 5.0), (1, 4, None, 10.0), (1, 5, 4, 20.0), (1, 6, 1, 9.0)]
    df = spark.createDataFrame(rows, "sid int, contour_id int, parent int, area double")
    assert [tuple(r) for r in polygons.filtered_contours(df, 1.0, 4.0, 2).collect()] == [(1, 0, 35.0, [1, 2])]
    assert polygons.filtered_contours(df.limit(0), 1.0, 4.0, 2).count() == 0

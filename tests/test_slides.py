"""Names, resolutions and grids: the edges of their rules."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import maps, text
from tilewright.operators import grid, metadata
from tilewright.plans import slides as plans


def one(spark, **columns):
    return lambda c: spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(c).first()[0]


@pytest.mark.parametrize(
    ("path", "name", "ext", "reader"),
    [("/a/x.svs", "x", ".svs", "openslide"), ("/a/x.OME.TIFF", "x", ".OME.TIFF", "openslide"), ("x.ome.zarr", "x", ".ome.zarr", "omezarr"), ("a/.hidden", ".hidden", "", "image"), ("a/b.c.PNG", "b.c", ".PNG", "image"), ("n", "n", "", "image"), ("é.czi", "é", ".czi", "czi")],
)
def test_names(spark, path, name, ext, reader):
    row = spark.createDataFrame([(path,)], "p string").select(text.stem(F.col("p")), text.extension(F.col("p")), text.reader(F.col("p"))).first()
    assert tuple(row) == (name, ext, reader)


def test_explicit_reader(spark):
    df = spark.createDataFrame([("a.svs", "cucim"), ("a.png", "openslide"), ("a.svs", None)], "p string, r string")
    assert [r[0] for r in df.select(text.reader(F.col("p"), F.col("r"))).collect()] == ["cucim", "openslide", "openslide"]
    with pytest.raises(Exception, match="does not take"):
        spark.createDataFrame([("a.svs", "czi")], "p string, r string").select(text.reader(F.col("p"), F.col("r"))).collect()


def test_labels(spark):
    get = one(spark, m=1.25, n=20.0, t="patch_features:uni:v1", l="x" * 201 + "\n", p="a_patches")
    assert get(text.magnification_text(F.col("m"))) == "1.25" and get(text.magnification_text(F.col("n"))) == "20"
    assert get(text.grid_folder(F.col("n"), F.lit(256), F.lit(0))) == "20x_256px_0px_overlap"
    assert get(text.task_parts(F.col("t"))[1]) == "uni:v1" and get(text.shortened(F.col("l"))) == "x" * 200 + "…" and get(text.without_suffix(F.col("p"))) == "a"
    assert get(text.is_path(F.lit("~x"))) and not get(text.is_path(F.lit("x")))
    assert get(text.patch_file(F.lit(7), F.lit(1), F.lit(2), "jpg")) == "000007_x1_y2.jpg"
    with pytest.raises(ValueError, match="format"):
        text.patch_file(F.lit(1), F.lit(1), F.lit(1), "bmp")


def test_buckets_are_open_above(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.16, 0.2, 0.3, 0.6, 1.2, None, float("nan"))], "m double")
    assert [r[0] for r in df.select(metadata.magnification(F.col("m"))).collect()] == [80, 60, 40, 20, 10, 5, None, None]
    bad = spark.createDataFrame([(2.4,)], "m double")
    assert bad.select(metadata.magnification(F.col("m"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="too low"):
        bad.select(metadata.magnification(F.col("m"))).collect()
    assert one(spark, m=3.0, o="40")(metadata.by_objective(F.col("m"), F.col("o"))) == 40


def test_level_choice(spark):
    pick = lambda w: tuple(one(spark, w=w)(metadata.level_choice(F.array(*[F.lit(v) for v in (1.0, 4.0, 16.0)]), F.col("w"))))
    assert pick(4.005) == (1, 1.0) and pick(8.0) == (1, 2.0) and pick(100.0) == (2, 6.25) and pick(0.5) == (0, 2.0)
    assert one(spark, w=1.0)(metadata.level_choice(F.array().cast("array<double>"), F.col("w"))) is None


def test_mpp_and_units(spark):
    get = one(spark, u="INCH", r=50800.0)
    props = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("0.25006"))
    assert get(metadata.mpp_of(props, ["a", "b"], F.col("u"), F.col("r"))) == 0.2501
    assert get(metadata.mpp_of(props, ["a"], F.col("u"), F.col("r"))) == 0.5
    assert get(metadata.in_microns(F.lit(2.0), F.lit("Millimeter"))) == 2000 and get(metadata.in_microns(F.lit(2.0), F.lit("parsec"))) is None


def test_lookup_takes_the_last_row(spark):
    lookup = spark.createDataFrame([("b.svs", 0.5, 1), ("a.svs", 0.1, 2), ("a.svs", 0.25, 3), (None, 9.0, 4)], "wsi string, mpp double, row int")
    slides = spark.createDataFrame([("a.svs",), ("b.svs",), ("c.svs",)], "wsi string")
    got = {r[0]: r[1] for r in metadata.with_lookup(slides, metadata.last_of(lookup, "wsi", "mpp", "row"), "wsi", "mpp").collect()}
    assert got == {"a.svs": 0.25, "b.svs": 0.5, "c.svs": None}


def test_maps(spark):
    get = one(spark, j='{"A": {"b": 1, "C": [1]}, "d": null}')
    assert get(maps.merged(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3, 'a', CAST(NULL AS INT))"))) == {"a": 1, "b": 3}
    assert get(maps.leaves(F.col("j"))) == {"a.b": "1", "a.c": "[1]", "d": None} and maps.flattened("[") == {}


def slides(spark, *rows):
    return spark.createDataFrame(rows, "sid long, w long, h long, mpp double")


def test_golden_grid(spark):
    rows = grid.scan_order(grid.patches(slides(spark, (1, 768, 512, 0.5)), 256, 20))
    xy = lambda name: [(r["x"], r["y"]) for r in grid.scan_order(rows.drop("patch_idx"), name).orderBy("patch_idx").collect()]
    assert xy("row-major") == [(0, 0), (256, 0), (512, 0), (0, 256), (256, 256), (512, 256)]
    assert xy("col-major") == [(0, 0), (0, 256), (256, 0), (256, 256), (512, 0), (512, 256)]
    with pytest.raises(ValueError, match="scan order"):
        grid.scan_order(rows, "diagonal")


@pytest.mark.parametrize("overlap", [0, 64, 128])
def test_overlap_sets_the_step(spark, overlap):
    xs = sorted({r["x"] for r in grid.patches(slides(spark, (1, 2000, 10, 0.5)), 512, 20, overlap).collect()})
    assert xs == list(range(0, 2000, 512 - overlap))
    with pytest.raises(ValueError, match="overlap"):
        grid.patches(slides(spark, (1, 10, 10, 0.5)), 64, 20, 64)


def test_odd_slides(spark):
    got = grid.patches(slides(spark, (1, 0, 10, 0.5), (2, 10, 10, None), (3, None, 10, 0.5), (4, 10, 10, 0.5)).withColumn("x", F.lit(1)).withColumn("by", F.lit(2)), 256)
    assert [r["sid"] for r in got.collect()] == [4]
    assert grid.patches(slides(spark).limit(0)).count() == 0


def test_rectangles_touch_and_overlap(spark):
    g = grid.patches(slides(spark, (1, 40, 40, 0.5)), 10, 20)
    boxes = spark.createDataFrame([(1, 0, 10, 10, 20, 20), (1, 1, 10, 10, 20, 20), (1, 2, 12, 12, 22, 14), (2, 0, 0, 0, 40, 40)], "sid long, tissue_id int, x0 long, y0 long, x1 long, y1 long")
    assert grid.touching_rectangles(g, boxes).count() == 9
    areas = {(r["x"], r["y"]): r["area"] for r in grid.on_rectangles(g, boxes, 0).collect()}
    assert areas == {(10, 10): 100, (20, 10): 4}
    assert [(r["x"], r["y"]) for r in grid.on_rectangles(g, boxes, 50).collect()] == [(10, 10)]
    assert grid.on_rectangles(g, boxes.limit(0), 25).count() == 0


def large_joins(spark, query):
    """The plan of a query on slides as Spark begins with it, if it may send a table to all tasks."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return plan if "Broadcast" in plan or "CartesianProduct" in plan else ""


@pytest.mark.parametrize("name", ["tissue_any", "tissue_prop", "tissue_patch_counts", "scan_order"])
def test_patches_stay_in_their_tasks(spark, name):
    assert not large_joins(spark, plans.QUERIES[name])


def test_rectangles_over_many_tiles(spark):
    """Against all pairs; rectangles that overlap, repeat, have no area or lie outside."""
    rng = random.Random(5)
    rects = {s: [(x, y, x + rng.choice((0, 3, 90, 700)), y + rng.choice((0, 5, 80, 600))) for x, y in ((rng.randint(-60, 900), rng.randint(-60, 900)) for _ in range(6))] for s in (1, 2)}
    boxes = spark.createDataFrame([(s, i, *r) for s, rs in rects.items() for i, r in enumerate([*rs, rs[0]])], "sid long, tissue_id int, x0 long, y0 long, x1 long, y1 long")
    g = grid.patches(slides(spark, (1, 800, 700, 0.5), (2, 650, 900, 0.5)), 20, 20, 6)
    touched, areas = set(), {}
    for s, ps, _, x, y in g.collect():
        if any(x <= c and x + ps >= a and y <= d and y + ps >= b for a, b, c, d in rects[s]):
            touched.add((s, x, y))
        cells = {(u, v) for a, b, c, d in rects[s] for u in range(max(a, x), min(c, x + ps)) for v in range(max(b, y), min(d, y + ps))}
        if cells:
            areas[s, x, y] = len(cells)
    got = [(r["sid"], r["x"], r["y"]) for r in grid.touching_rectangles(g, boxes).collect()]
    assert len(got) == len(set(got)) and set(got) == touched
    for percent in (0, 25):
        got = {(r["sid"], r["x"], r["y"]): r["area"] for r in grid.on_rectangles(g, boxes, percent).collect()}
        assert got == {k: v for k, v in areas.items() if v * 100 >= 400 * percent}

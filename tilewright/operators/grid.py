"""Patch grids of slides, and the spatial semi-join of patches with tissue.

Slides are (sid, w, h) and either mpp or the size of a patch in level-0 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import require
from tilewright.operators.metadata import magnification

__all__ = ["column_row", "magnification", "of_column_row", "on_rectangles", "patches", "scan_order", "sized", "spread", "touching_rectangles"]


def sized(slides: DataFrame, size: int = 512, target: int = 20, overlap: int = 0) -> DataFrame:
    """slides (.., mpp) with ps and step: a patch of `size` pixels at magnification `target`, and
    the way from one to the next, in level-0 pixels, each rounded half to even. Slides without
    mpp have none and are left out. overlap >= size is an error."""
    if overlap >= size:
        raise ValueError("overlap must be less than the size of a patch")
    factor = magnification(F.col("mpp")) / F.lit(float(target))
    ps = F.bround(F.lit(float(size)) * factor).cast("long")
    return slides.withColumn("ps", ps).withColumn("step", ps - F.bround(F.lit(float(overlap)) * factor).cast("long")).where("ps > 0 AND step > 0")


def patches(slides: DataFrame, size: int = 512, target: int = 20, overlap: int = 0) -> DataFrame:
    """(sid, ps, step, x, y): all patches of the slides; those at the edge may overhang.

    Columns and rows are generated where the slide's row lies, without a shuffle. Slides of no
    width or height have no patch. slides may have ps and step already, or mpp (see sized()).
    """
    require(slides, "sid", "w", "h")
    grid = slides if {"ps", "step"} <= set(slides.columns) else sized(slides, size, target, overlap)
    grid = grid.where("w > 0 AND h > 0 AND ps > 0 AND step > 0").select("sid", "ps", "step", "w", "h")
    cols = grid.withColumn("x", F.explode(F.expr("sequence(0L, CAST(w - 1 AS BIGINT), CAST(step AS BIGINT))")))
    return cols.withColumn("y", F.explode(F.expr("sequence(0L, CAST(h - 1 AS BIGINT), CAST(step AS BIGINT))"))).select("sid", "ps", "step", "x", "y")


def column_row(x: Column, y: Column, ps: Column, step: Column) -> tuple[Column, Column]:
    """Column and row of a patch from its corner: 0 at 0, else floor((x - ps) / step) + 1."""
    at = lambda v: F.when(v == 0, F.lit(0).cast("long")).otherwise(F.floor((v - ps) / step).cast("long") + 1)
    return at(x), at(y)


def of_column_row(col: Column, row: Column, step: Column) -> tuple[Column, Column]:
    return col * step, row * step


def scan_order(grid: DataFrame, order: str = "row-major") -> DataFrame:
    """grid with patch_idx, from 0 in each slide. It follows from the patch's place alone, so
    there is nothing to sort: patches of a row (or column) before it, and in it."""
    if order not in ("row-major", "col-major"):
        raise ValueError(f"unknown scan order: {order}")
    require(grid, "sid", "x", "y", "step")
    size = grid.groupBy("sid").agg((F.max("x") / F.max("step") + 1).cast("long").alias("__cols"), (F.max("y") / F.max("step") + 1).cast("long").alias("__rows"))
    col, row = (F.col("x") / F.col("step")).cast("long"), (F.col("y") / F.col("step")).cast("long")
    idx = row * F.col("__cols") + col if order == "row-major" else col * F.col("__rows") + row
    return grid.join(size, "sid").withColumn("patch_idx", idx).drop("__cols", "__rows")


def spread(slides: DataFrame) -> DataFrame:
    """slides dealt out to as many tasks as a shuffle has. A table of slides is small and often one
    split, and all patches of its slides would come from one task; rows of slides are moved, not
    patches."""
    n = int(slides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slides.repartition(n, "sid")


def _tiles(tissue: DataFrame, sizes: DataFrame, side: int = 16) -> DataFrame:
    """(sid, ps, __bx, __by, __boxes): the rectangles that meet or touch a patch whose corner lies
    in a tile of `side` x `side` patches, for each tile that has any; repeats are one."""
    at = lambda v: F.floor(v / (F.col("ps") * side))
    tiles = lambda lo, hi: F.explode(F.sequence(at(F.least(lo, hi) - F.col("ps")), at(F.greatest(lo, hi))))
    boxes = tissue.select("sid", "x0", "y0", "x1", "y1").join(sizes.select("sid", "ps").distinct().hint("merge"), "sid")
    boxes = boxes.withColumn("__bx", tiles(F.col("x0"), F.col("x1"))).withColumn("__by", tiles(F.col("y0"), F.col("y1")))
    return boxes.groupBy("sid", "ps", "__bx", "__by").agg(F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("__boxes"))


def _with_boxes(grid: DataFrame, tissue: DataFrame, sizes: DataFrame | None, side: int = 16) -> DataFrame:
    """grid with __boxes, the rectangles of its tile (see _tiles); patches of tiles without any are
    left out. A patch is in one tile, so it is one row before and after. sizes (sid, ps) are the
    sizes of patches that the grid has; without them the grid is read once more to see.

    Spark takes a grid for as small as the table of slides that it is generated from, and would
    send all patches to the driver and to every task; the hint keeps it from that.
    """
    at = lambda c: F.floor(F.col(c) / (F.col("ps") * side))
    placed = grid.withColumn("__bx", at("x")).withColumn("__by", at("y"))
    return placed.join(_tiles(tissue, grid if sizes is None else sizes, side).hint("merge"), ["sid", "ps", "__bx", "__by"])


def touching_rectangles(grid: DataFrame, tissue: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The patches that meet or touch a rectangle (sid, tissue_id, x0, y0, x1, y1) of their slide;
    sizes as in _with_boxes()."""
    right, low = F.col("x") + F.col("ps"), F.col("y") + F.col("ps")
    meets = F.exists("__boxes", lambda r: (F.col("x") <= r["x1"]) & (right >= r["x0"]) & (F.col("y") <= r["y1"]) & (low >= r["y0"]))
    return _with_boxes(grid, tissue, sizes).where(meets).select(*grid.columns)


def on_rectangles(grid: DataFrame, tissue: DataFrame, percent: int, sizes: DataFrame | None = None) -> DataFrame:
    """The patches of which at least `percent` % lie on rectangles (sid, tissue_id, x0, y0, x1,
    y1) of their slide, however these overlap.

    Filter: tiles (see _with_boxes), then the rectangles met. Refine: the area of the union is
    summed over the cells that the edges of the rectangles met cut the patch into, each counted
    once. Rectangles of no area and repeats don't matter; percent 0 keeps those that share any
    area.
    """
    inner = lambda lo, hi, p: (F.greatest(lo, F.col(p)), F.least(hi, F.col(p) + F.col("ps")))

    def cut(r: Column) -> Column:
        (a, b), (c, d) = inner(r["x0"], r["x1"], "x"), inner(r["y0"], r["y1"], "y")
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))

    def area(m: Column) -> Column:
        one = lambda r: ((r["b"] - r["a"]) * (r["d"] - r["c"])).cast("long")
        cuts = lambda u, v: F.array_sort(F.array_union(F.transform(m, lambda r: r[u]), F.transform(m, lambda r: r[v])))
        cell = lambda s, i, j: F.exists(s["m"], lambda r: (r["a"] <= s["xs"][i]) & (r["b"] > s["xs"][i]) & (r["c"] <= s["ys"][j]) & (r["d"] > s["ys"][j]))
        column = lambda s, i: F.aggregate(
            F.sequence(F.lit(0), F.size(s["ys"]) - 2), F.lit(0).cast("long"), lambda t, j: t + F.when(cell(s, i, j), s["ys"][j + 1] - s["ys"][j]).otherwise(F.lit(0)).cast("long")
        )
        whole = lambda s: F.aggregate(F.sequence(F.lit(0), F.size(s["xs"]) - 2), F.lit(0).cast("long"), lambda t, i: t + column(s, i) * (s["xs"][i + 1] - s["xs"][i]).cast("long"))
        many = F.transform(F.array(F.struct(m.alias("m"), cuts("a", "b").alias("xs"), cuts("c", "d").alias("ys"))), whole)[0]
        return F.when(F.size(m) == 1, one(m[0])).when(F.size(m) > 1, many)

    met = F.filter(F.transform("__boxes", cut), lambda r: (r["a"] < r["b"]) & (r["c"] < r["d"]))
    kept = F.filter(F.transform(F.array(met), area), lambda v: v * 100 >= F.col("ps") * F.col("ps") * percent)  # in one expression, so that it is computed once
    return _with_boxes(grid, tissue, sizes).withColumn("area", F.explode(kept)).select(*grid.columns, "area")


def drawn(x: Column, y: Column, ps: Column, downsample: Column) -> Column:
    """struct<x, y, side> of a patch on a picture that is smaller by `downsample`, cut off; a side is
    one pixel at least."""
    cut = lambda v: (v / downsample).cast("int")
    return F.struct(cut(x).alias("x"), cut(y).alias("y"), F.greatest(F.lit(1), cut(ps)).alias("side"))


def from_legacy(coords: DataFrame, levels: Column) -> DataFrame:
    """coords (.., patch_size, patch_level, custom_downsample) of the former layout, with what the
    present one has: patch_size_level0 and the magnification or resolution read at. levels are the
    slide's downsamples; custom_downsample is 1 if null."""
    require(coords, "patch_size", "patch_level", "custom_downsample")
    ratio = F.get(levels, F.col("patch_level")) * F.coalesce(F.col("custom_downsample"), F.lit(1))
    return coords.withColumn("ratio", ratio.cast("double")).withColumn("patch_size_level0", F.bround(F.col("patch_size") * F.col("ratio")).cast("long"))


def checked_places(df: DataFrame, coords: str = "coords") -> DataFrame:
    """df with x and y of its coords; an error unless each is two whole numbers. Empty is fine."""
    c = F.col(coords).cast("array<double>")
    good = (F.size(c) == 2) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v - F.bround(v)) <= 1e-8 + 1e-5 * F.abs(v)))
    at = lambda i: F.when(F.coalesce(good, F.lit(False)), F.bround(c[i]).cast("long")).otherwise(F.raise_error(F.lit("coords must be two whole numbers")).cast("long"))
    return df.withColumn("x", at(0)).withColumn("y", at(1))

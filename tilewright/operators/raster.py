"""Pixels and masks: thresholds from histograms, tissue of tiles, components, contours, colours.

What is relational (histograms, accumulation over tiles, pyramids) is done in expressions; what
needs a whole raster is done per tile in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import require


def otsu(df: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """(key, threshold): the middle of the bin of a histogram of each key's values that parts them
    with the largest variance between the parts; of equals the lowest. One value only is its own
    threshold. Only counts of bins are shuffled and ordered. Null and NaN values don't count."""
    require(df, key, value)
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(key).alias("k"), v.alias("v"))
    ends = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(ends.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).select("k", "lo", "hi", place.alias("b"))
    counts = binned.groupBy("k", "lo", "hi", "b").agg(F.count("*").cast("double").alias("c"))
    mid = F.col("lo") + (F.col("b") + 0.5) * width
    counts = counts.withColumn("mid", F.when(F.col("hi") > F.col("lo"), mid).otherwise(F.col("lo")))
    run = "OVER (PARTITION BY k ORDER BY b)"
    sums = counts.select("*", F.expr(f"sum(c) {run}").alias("w1"), F.expr(f"sum(c * mid) {run}").alias("s1"), F.expr("sum(c) OVER (PARTITION BY k)").alias("w"), F.expr("sum(c * mid) OVER (PARTITION BY k)").alias("s"))
    w2 = F.col("w") - F.col("w1")
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / F.nullif(w2, F.lit(0.0))
    between = F.coalesce(F.round(F.col("w1") * w2 * gap * gap, 6), F.lit(-1.0))
    return sums.withColumn("between", between).groupBy(F.col("k").alias(key)).agg(F.max_by("mid", F.struct("between", -F.col("b"))).alias("threshold"))


def accumulated(tiles: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """(sid, mx, my, hits, label): cells of a slide's mask that tiles (sid, x, y, side, label) cover,
    with the number of tiles that are not 0 there and the largest label. Cells outside of
    width x height are cut off, if these are given."""
    require(tiles, "sid", "x", "y", "side", "label")
    rows = tiles.where("side > 0 AND label IS NOT NULL")
    cells = rows.withColumn("mx", F.explode(F.expr("sequence(x, x + side - 1)"))).withColumn("my", F.explode(F.expr("sequence(y, y + side - 1)"))).where("mx >= 0 AND my >= 0")
    if width is not None:
        cells = cells.where(F.col("mx") < width)
    if height is not None:
        cells = cells.where(F.col("my") < height)
    return cells.groupBy("sid", "mx", "my").agg(F.count_if(F.col("label") > 0).alias("hits"), F.max("label").alias("label"))


#: Cells of a mask's row that one number holds.
WORD = 32


def covered(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """(sid, my, word, bits): the cells of width x height that tiles (sid, x, y, side, label) whose
    label is above 0 cover, those of accumulated() with hits; bit i of `bits` is the cell
    mx = word * WORD + i of row my. A tile is one row for each row of the mask it covers, not for
    each cell, and only words are shuffled."""
    require(tiles, "sid", "x", "y", "side", "label")
    cut = tiles.where("side > 0 AND label > 0").selectExpr(
        "sid", "CAST(greatest(x, 0) AS BIGINT) AS x0", f"CAST(least(x + side, {width}) - 1 AS BIGINT) AS x1", "CAST(greatest(y, 0) AS BIGINT) AS y0", f"CAST(least(y + side, {height}) - 1 AS BIGINT) AS y1"
    )
    rows = cut.where("x0 <= x1 AND y0 <= y1").withColumn("my", F.explode(F.expr("sequence(y0, y1)")))
    if width > WORD:
        rows = rows.withColumn("word", F.explode(F.expr(f"sequence(x0 div {WORD}, x1 div {WORD})")))
    else:
        rows = rows.withColumn("word", F.lit(0).cast("bigint"))
    first, last = f"CAST(greatest(x0 - word * {WORD}, 0) AS INT)", f"CAST(least(x1 - word * {WORD}, {WORD - 1}) AS INT)"
    bits = F.expr(f"shiftleft(1L, {last} + 1) - shiftleft(1L, {first})")
    return rows.select("sid", "my", "word", bits.alias("bits")).groupBy("sid", "my", "word").agg(F.expr("bit_or(bits)").alias("bits"))


def drawn(rows: DataFrame, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """(sid, h, w, scale, mask) of rows as covered() gives them: masks of height x width labels,
    0 and 1, for mask_polygons()."""
    across = -(-width // WORD)
    packed = rows.groupBy("sid").agg(F.collect_list(F.struct((F.col("my") * across + F.col("word")).cast("int").alias("at"), "bits")).alias("rows"))

    @F.pandas_udf("binary")
    def mask(at: pd.Series, bits: pd.Series) -> pd.Series:
        words = np.zeros((len(at), height * across), dtype="<u4")
        words[np.repeat(np.arange(len(at)), at.map(len)), np.concatenate(at.to_numpy())] = np.concatenate(bits.to_numpy())
        cells = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(len(at), height, across * WORD)[:, :, :width]
        return pd.Series([c.tobytes() for c in cells])

    return packed.select("sid", F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(scale).alias("scale"), mask(F.col("rows.at"), F.col("rows.bits")).alias("mask"))


def binarised(label: Column) -> Column:
    return F.when(label > 0, 255).otherwise(0)


def pyramid(cells: DataFrame, level: int) -> DataFrame:
    """(sid, mx, my, v): cells (sid, mx, my, v) of a level of half the size each, by averages."""
    f = F.lit(1 << level)
    return cells.groupBy("sid", F.floor(F.col("mx") / f).alias("mx"), F.floor(F.col("my") / f).alias("my")).agg(F.avg("v").alias("v"))


# Weights of red, green and blue in the grey of a pixel.
GREY = (0.2125, 0.7154, 0.0721)


def grey(r: Column, g: Column, b: Column) -> Column:
    return GREY[0] * r + GREY[1] * g + GREY[2] * b


def blended(over: Column, under: Column, share: float = 0.6) -> Column:
    return over * share + under * (1 - share)


def coloured(score: Column, table: list[tuple[int, int, int]]) -> Column:
    """struct<r, g, b> of a score in [0, 1] from a table of colours; null and NaN have none."""
    at = F.least(F.greatest(F.floor(score * len(table)), F.lit(0)), F.lit(len(table) - 1)).cast("int")
    colours = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb")]) for c in table])
    return F.when(score.isNotNull() & ~F.isnan(score), F.get(colours, at))


def threshold_of(values: np.ndarray, bins: int = 256) -> float:
    """otsu() of one array."""
    lo, hi = float(values.min()), float(values.max())
    if lo == hi:
        return lo
    counts, at = np.histogram(values, bins, (lo, hi))
    mid = (at[:-1] + at[1:]) / 2
    w1, s1 = np.cumsum(counts), np.cumsum(counts * mid)
    w2, s2 = w1[-1] - w1, s1[-1] - s1
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w1 * w2 * (s1 / w1 - s2 / w2) ** 2
    return float(mid[np.nanargmax(between[:-1])])


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(label of each pixel, number of components): pixels that share a side, by pointer jumping
    over the runs of rows; 0 is outside."""
    n = mask.size
    parent = np.arange(n).reshape(mask.shape)
    while True:
        low = parent.copy()
        for axis in (0, 1):
            a, b = [slice(None)] * 2, [slice(None)] * 2
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            both = mask[tuple(a)] & mask[tuple(b)]
            m = np.where(both, np.minimum(low[tuple(a)], low[tuple(b)]), 0)
            low[tuple(a)] = np.where(both, m, low[tuple(a)])
            low[tuple(b)] = np.where(both, np.minimum(m, low[tuple(b)]), low[tuple(b)])
        flat = low.reshape(-1)
        roots = parent.reshape(-1).copy()
        np.minimum.at(roots, parent.reshape(-1), flat)
        new = roots[roots[flat]].reshape(mask.shape)
        if (new == parent).all():
            break
        parent = new
    ids, label = np.unique(parent[mask], return_inverse=True)
    out = np.zeros(mask.shape, dtype=np.int32)
    out[mask] = label + 1
    return out, len(ids)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without components of fewer than `least` pixels."""
    label, n = components(mask)
    keep = np.bincount(label.reshape(-1), minlength=n + 1) >= least
    keep[0] = False
    return keep[label]


def filled(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask with holes of fewer than `least` pixels filled."""
    return ~without_small(~mask, least)


def tissue(tile: np.ndarray) -> np.ndarray:
    """Tissue of a tile (h, w, 3; uint8) as a boolean mask, in two passes of otsu(): black padding,
    grey and near-black pixels are background; the first pass drops objects below 60 pixels, the
    second fills holes below 5000."""
    given = tile.astype(np.float64)
    given[(tile == 0).all(axis=-1)] = 255
    rgb = given.copy()
    value, low = rgb.max(axis=-1), rgb.min(axis=-1)
    saturation = np.where(value > 0, np.round((value - low) * 255 / np.maximum(value, 1)), 0)
    rgb[((saturation <= 10) & (value >= 70)) | (value <= 85)] = 255
    level = rgb @ np.array(GREY)
    mask = without_small(level < threshold_of(level), 60)
    level = np.where(mask[..., None], given, np.where(given > 0, 255, 0)) @ np.array(GREY)
    return filled(level < threshold_of(level), 5000)


def contours(mask: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(outer ring, rings of holes) of each component, along the edges of pixels, as corners."""
    corners, ends, _, parts = _outlines(mask)
    ring = lambda i: corners[ends[i] : ends[i + 1]]
    return [(ring(outer), [ring(i) for i in holes]) for outer, *holes in parts]


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, end) of the runs of set cells in rows, in their order."""
    width = cells.shape[1] + 1  # with a free column, so that no run goes on in the next row
    steps = np.diff(np.pad(cells, ((0, 0), (0, 1))).reshape(-1).view(np.int8), prepend=0)
    row, first = np.divmod(np.nonzero(steps == 1)[0], width)
    return row, first, np.nonzero(steps == -1)[0] - row * width


def _outlines(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """(corners (n, 2: x, y) of all rings, where each ring begins and the last ends, area of each
    ring, rings of each component: the outer, then its holes). Components follow each other by
    their first pixel. Rings are walks along the edges of pixels, the mask on the right; where
    two corners of the mask meet, a walk keeps to the own side."""
    height, width = mask.shape[0], mask.shape[1] + 1
    m = np.pad(mask.astype(bool), 1)
    inside = np.ascontiguousarray(m[1:-1, 1:-1])
    sides = []  # straight ways right, down, left and up: way, corner where it begins, corner where it ends
    for way, (dx, dy) in enumerate(((0, -1), (1, 0), (0, 1), (-1, 0))):
        edge = inside & ~m[1 + dy : height + 1 + dy, 1 + dx : width + dx]
        line, lo, hi = _runs(np.ascontiguousarray(edge if way % 2 == 0 else edge.T))
        line = line + (way in (1, 2))
        at = (lambda v, line=line: line * width + v) if way % 2 == 0 else (lambda v, line=line: v * width + line)
        begin, end = (at(lo), at(hi)) if way < 2 else (at(hi), at(lo))
        sides.append((np.full(len(line), way), begin, end))
    way, begin, end = (np.concatenate(x) for x in zip(*sides))
    if not len(way):
        return np.empty((0, 2), int), np.zeros(1, int), np.empty(0), []
    keys = way * ((height + 1) * width) + begin
    order = np.argsort(keys)
    ranked = keys[order]

    def starting(turn: int) -> np.ndarray:
        key = (way + turn) % 4 * ((height + 1) * width) + end
        i = np.minimum(np.searchsorted(ranked, key), len(ranked) - 1)
        return np.where(ranked[i] == key, order[i], -1)

    right = starting(1)
    after = np.where(right >= 0, right, starting(3)).tolist()
    seen, walk, firsts, heads = bytearray(len(after)), [], [], []
    for s in range(len(sides[0][0])):  # each ring has a way to the right
        if not seen[s]:
            firsts.append(len(walk))
            heads.append(s)
            while not seen[s]:
                seen[s] = 1
                walk.append(s)
                s = after[s]
    corners = np.stack([begin[walk] % width, begin[walk] // width], axis=1)
    ends = np.array([*firsts, len(walk)])
    following = np.arange(1, len(walk) + 1)
    following[ends[1:] - 1] = ends[:-1]
    area = np.abs(np.add.reduceat(corners[:, 0] * corners[following, 1] - corners[following, 0] * corners[:, 1], ends[:-1])) / 2

    row, lo, hi = _runs(inside)
    starts, stops = row * width + lo, row * width + hi
    one, two = np.searchsorted(stops, starts - width, side="right"), np.searchsorted(starts, stops - width, side="left")
    n = np.maximum(0, two - one)  # runs in the row above that share a column
    below = np.repeat(np.arange(len(starts)), n)
    above = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + one[below]
    parent = list(range(len(starts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(above.tolist(), below.tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    own = np.searchsorted(starts, begin[heads], side="right") - 1  # the run below the first way of each ring
    parts: dict[int, list[int]] = {}
    for ring, run in enumerate(own.tolist()):
        parts.setdefault(root(run), []).append(ring)
    for rings in parts.values():
        rings.insert(0, rings.pop(int(np.argmax(area[rings])) if len(rings) > 1 else 0))
    return corners, ends, area, [parts[i] for i in sorted(parts)]


TILE = "sid string, x bigint, y bigint, tissue_pixels bigint, n_regions int"


def segmented(tiles: DataFrame, segment: Callable[[np.ndarray], np.ndarray] = tissue) -> DataFrame:
    """tiles (sid, x, y, h, w, pixels: binary of h * w * 3) -> (sid, x, y, tissue_pixels,
    n_regions) by tissue(), or by an own function from a tile to a mask, in Arrow batches. Tiles without pixels, or of another size than they
    say, have null counts."""
    require(tiles, "sid", "x", "y", "h", "w", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[tuple] = []
            for h, w, p in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                if p is None or not h or not w or len(p) != h * w * 3:
                    counts.append((None, None))
                    continue
                mask = segment(np.frombuffer(p, dtype=np.uint8).reshape(h, w, 3)).astype(bool)
                counts.append((int(mask.sum()), components(mask)[1]))
            yield pa.record_batch([*batch.columns[:3], pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int32())], names=["sid", "x", "y", "tissue_pixels", "n_regions"])

    rows = tiles.select(F.col("sid").cast("string"), F.col("x").cast("bigint"), F.col("y").cast("bigint"), F.col("h").cast("int"), F.col("w").cast("int"), "pixels")
    return rows.mapInArrow(run, TILE)


#: Cells of masks that are traced at once.
STACKED = 500_000
POLYGONS = "sid string, label int, tissue_id int, rings array<array<struct<x:double,y:double>>>"


def mask_polygons(masks: DataFrame, least_area: float = 0, least_hole: float = 0, most_holes: int = 20) -> DataFrame:
    """masks (sid, h, w, scale, mask: binary of h * w labels) -> (sid, label, tissue_id, rings): the
    outlines of each label but 0, times `scale`, cut off to whole numbers. Outlines of a net area
    of at most least_area cells are left out; of the holes above least_hole the largest stay.
    tissue_id counts from 0 in each mask. A mask is one value, so it is held by one task as it
    is; masks of another size than they say give no rows."""
    require(masks, "sid", "h", "w", "scale", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, heights, widths, scales, given = (c.to_pylist() for c in batch.columns)
            alike: dict[tuple[int, int], list[int]] = {}
            for i, (h, w, m) in enumerate(zip(heights, widths, given)):
                if m is not None and h and w and len(m) == h * w:
                    alike.setdefault((h, w), []).append(i)
            out: list[tuple] = []
            for (h, w), rows in alike.items():
                most = max(1, STACKED // (h * w))
                for k in range(0, len(rows), most):
                    out += shapes(h, w, rows[k : k + most], scales, given)
            out.sort(key=lambda o: o[:2])
            ids, before = [], None
            for i, *_ in out:
                ids.append(ids[-1] + 1 if i == before else 0)
                before = i
            rings = [r for o in out for r in o[2]]
            points = np.concatenate(rings) if rings else np.empty((0, 2))
            ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
            nested = pa.ListArray.from_arrays(ends([len(o[2]) for o in out]), pa.ListArray.from_arrays(ends([len(r) for r in rings]), flat))
            yield pa.record_batch([pa.array([sids[o[0]] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array(ids, pa.int32()), nested], names=["sid", "label", "tissue_id", "rings"])

    def shapes(h: int, w: int, rows: list[int], scales: list, given: list) -> list[tuple]:
        """(row, label, rings) of masks of one size, traced as one mask, one below the other."""
        labels, out = np.frombuffer(b"".join(given[i] for i in rows), dtype=np.uint8).reshape(-1, h, w), []
        scale = np.array([scales[i] for i in rows], dtype=float)
        for value in np.unique(labels[labels > 0]).tolist():
            corners, ends, area, parts = _outlines(np.pad(labels == value, ((0, 0), (0, 1), (0, 0))).reshape(-1, w))
            at = corners[ends[:-1], 1] // (h + 1)  # a ring begins above a cell of its mask
            each = np.repeat(at, np.diff(ends))
            points = np.trunc((corners - np.stack([0 * each, each * (h + 1)], axis=1)) * scale[each, None])
            for outer, *holes in parts:
                if area[outer] - sum(area[i] for i in holes) <= least_area:
                    continue
                kept = sorted((i for i in holes if area[i] > least_hole), key=lambda i: -area[i])[:most_holes]
                out.append((rows[at[outer]], value, [points[ends[i] : ends[i + 1]] for i in (outer, *kept)]))
        return out

    rows = masks.select(F.col("sid").cast("string"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("scale").cast("double"), "mask")
    return rows.mapInArrow(run, POLYGONS)

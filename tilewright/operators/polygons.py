"""Tissue as polygons with holes: the semi-join of patches with their union, simplification,
repair, and the contours that become polygons.

Polygons are (sid, tissue_id, rings): rings is an array of rings, the outer one first, each an
array<struct<x:double,y:double>>; inside is what an odd number of a polygon's rings encloses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.common import require

#: Up to so many sides in a tile, areas of its patches are cut at once; beyond, patches see only the polygons near them.
AT_ONCE = 64

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings: list[np.ndarray]) -> np.ndarray:
    """(x, y, x, y) of the sides of all rings."""
    out = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings if len(r) >= 3]
    return np.concatenate(out) if out else np.empty((0, 4))


def union_area(polygons: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> float:
    """Area that the union of polygons (as edges()) has in common with a rectangle: slabs between
    all abscissas where sides begin, end, cross each other or cross the rectangle's, in which the
    covered height is linear."""
    near = []
    for p, e in enumerate(polygons):
        keep = (np.minimum(e[:, 0], e[:, 2]) < x1) & (np.maximum(e[:, 0], e[:, 2]) > x0) & (e[:, 0] != e[:, 2])
        near.append(np.hstack([e[keep], np.full((int(keep.sum()), 1), p)]))
    e = np.concatenate(near) if near else np.empty((0, 5))
    if not len(e):
        return 0.0
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (base[None, :] - base[:, None]) / (slope[:, None] - slope[None, :])
        level = np.concatenate([(y - base) / slope for y in (y0, y1)])
    marks = np.concatenate([e[:, 0], e[:, 2], cross.reshape(-1), level, [x0, x1]])
    marks = np.unique(marks[np.isfinite(marks) & (marks >= x0) & (marks <= x1)])
    area = 0.0
    for a, b in zip(marks[:-1], marks[1:]):
        m = (a + b) / 2
        over = (np.minimum(e[:, 0], e[:, 2]) < m) & (np.maximum(e[:, 0], e[:, 2]) > m)
        spans = []
        for p in np.unique(e[over, 4]):
            own = over & (e[:, 4] == p)
            ys = np.sort(slope[own] * m + base[own])
            spans += zip(np.clip(ys[0::2], y0, y1), np.clip(ys[1::2], y0, y1))
        top = y0
        for lo, hi in sorted(spans):
            if hi > top:
                area += (b - a) * (hi - max(lo, top))
                top = hi
    return area


def union_areas(polygons: list[np.ndarray], boxes: np.ndarray) -> np.ndarray:
    """union_area() for boxes (n, 4: x0, y0, x1, y1), all of them at once: slabs of all boxes are
    rows, sides are columns."""
    e = np.concatenate([np.hstack([p, np.full((len(p), 1), i)]) for i, p in enumerate(polygons)]) if polygons else np.empty((0, 5))
    e = e[(e[:, 0] != e[:, 2]) & np.isfinite(e).all(axis=1)]
    out = np.zeros(len(boxes))
    if not len(e) or not len(boxes):
        return out
    x0, y0, x1, y1 = (boxes[:, [i]] for i in range(4))
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (base[None, :] - base[:, None]) / (slope[:, None] - slope[None, :])
        both = (cross > np.maximum(left[:, None], left[None, :])) & (cross < np.minimum(right[:, None], right[None, :]))
        tilted = slope != 0
        level = np.concatenate([(y - base[tilted]) / slope[tilted] for y in (y0, y1)], axis=1)
    fixed = np.unique(np.concatenate([left, right, cross[both]]))
    if len(boxes) > 1 and len(boxes) * (len(fixed) + level.shape[1] + 2) * len(e) > 4_000_000:  # some 100 MB
        return np.concatenate([union_areas(polygons, part) for part in np.array_split(boxes, 2)])
    marks = np.sort(np.concatenate([np.clip(np.broadcast_to(fixed, (len(boxes), len(fixed))), x0, x1), np.clip(level, x0, x1), x0, x1], axis=1), axis=1)
    box, at = np.nonzero(marks[:, 1:] > marks[:, :-1])
    a, b = marks[box, at], marks[box, at + 1]
    m = (a + b) / 2
    over = (left < m[:, None]) & (right > m[:, None])
    height = np.where(over, slope * m[:, None] + base, np.inf)
    low, high = y0[box], y1[box]
    begins, ends = [], []
    for i in np.unique(e[:, 4]):
        own = e[:, 4] == i
        ys = np.sort(height[:, own], axis=1)[:, : int(own.sum()) // 2 * 2]
        paired = np.isfinite(ys[:, 1::2])
        begins.append(np.where(paired, np.clip(ys[:, 0::2], low, high), high))
        ends.append(np.where(paired, np.clip(ys[:, 1::2], low, high), high))
    lo, hi = np.concatenate(begins, axis=1), np.concatenate(ends, axis=1)
    order = np.argsort(lo, axis=1, kind="stable")
    lo, hi = np.take_along_axis(lo, order, 1), np.take_along_axis(hi, order, 1)
    top = np.maximum.accumulate(np.concatenate([low, hi], axis=1), axis=1)[:, :-1]  # what is covered up to here
    np.add.at(out, box, (b - a) * np.maximum(0, hi - np.maximum(lo, top)).sum(axis=1))
    return out


def located(polygons: list[np.ndarray], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inside, near), for boxes (n, 4: x0, y0, x1, y1): whether a polygon holds the whole box, and
    for each polygon (columns) whether a side of it comes near the box."""
    inside = np.zeros(len(boxes), dtype=bool)
    near = np.zeros((len(boxes), len(polygons)), dtype=bool)
    x0, y0, x1, y1 = (boxes[:, [i]] for i in range(4))
    for p, e in enumerate(polygons):
        left, right, low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
        near[:, p] = ((left <= x1) & (right >= x0) & (low <= y1) & (high >= y0)).any(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = e[:, 1] + (x0 - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        inside |= (((left <= x0) & (right > x0) & (at <= y0)).sum(axis=1) % 2 == 1) & ~near[:, p]
    return inside, near


def touches(polygons: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether a closed rectangle and a polygon have a point in common."""
    for e in polygons:
        if not len(e):
            continue
        lo, hi = np.zeros(len(e)), np.ones(len(e))
        dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
        for d, q in ((-dx, e[:, 0] - x0), (dx, x1 - e[:, 0]), (-dy, e[:, 1] - y0), (dy, y1 - e[:, 1])):
            with np.errstate(divide="ignore", invalid="ignore"):
                t = q / d
            lo = np.where(d < 0, np.maximum(lo, t), lo)
            hi = np.where(d > 0, np.minimum(hi, t), hi)
            hi = np.where((d == 0) & (q < 0), -1.0, hi)
        if (lo <= hi).any():
            return True
        above = (e[:, 1] > y0) != (e[:, 3] > y0)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = e[:, 0] + (y0 - e[:, 1]) * dx / dy
        if (above & (at > x0)).sum() % 2:
            return True
    return False


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring without points that lie within the tolerance of what remains (Douglas-Peucker
    between its two ends farthest apart from the first point); never fewer than three."""
    if len(ring) < 4 or tolerance <= 0:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, far]] = True
    whole = np.vstack([ring, ring[:1]])
    stack = [(0, far), (far, len(ring))]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = whole[b] - whole[a]
        inner = whole[a + 1 : b] - whole[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            at = a + 1 + k
            keep[at] = True
            stack += [(a, at), (at, b)]
    return ring[keep] if keep.sum() >= 3 else ring


def repaired(ring: np.ndarray) -> np.ndarray | None:
    """The ring without repeated points and without points on a straight way back; None if it
    encloses nothing. Rings that cross themselves stay as they are."""
    r = ring[np.isfinite(ring).all(axis=1)]
    while len(r) >= 3:
        before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
        turn = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]
        back = (turn == 0) & ((before * after).sum(axis=1) <= 0)
        if not back.any():
            break
        r = np.delete(r, int(np.nonzero(back)[0][0]), axis=0)
    area = (r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum() / 2 if len(r) >= 3 else 0
    return r if area else None


def on_polygons(grid: DataFrame, tissue: DataFrame, threshold: float = 0.15, tolerance: float = 0.0, tile: int = 16, sizes: DataFrame | None = None) -> DataFrame:
    """The patches (sid, ps, x, y) of which at least the share `threshold` lies on the union of
    their slide's polygons; threshold 0 keeps those that touch it.

    Filter: patches and the boxes of polygons meet in tiles of `tile` patches; a patch is in one
    tile, a polygon in all that its box, widened by a patch, covers. Refine: exact area of the
    union (union_area). A task holds the patches and polygons of one tile. Polygons are
    simplified first if a tolerance is given. Null or degenerate rings, and slides without
    polygons, keep nothing. sizes (sid, ps) spare reading the grid for its sizes. Extra columns of the grid are kept, those of tissue ignored.
    """
    require(grid, "sid", "ps", "x", "y")
    require(tissue, "sid", "rings")
    own = (grid if sizes is None else sizes).select("sid", "ps").distinct().hint("merge")  # a grid counts as small as its slides
    at = lambda v: F.floor(v / (F.col("ps") * tile))
    left = grid.withColumn("__bx", at(F.col("x"))).withColumn("__by", at(F.col("y")))
    outer = F.get(F.col("rings"), F.lit(0))
    low, high = (lambda k: F.array_min(F.transform(outer, lambda p: p[k]))), (lambda k: F.array_max(F.transform(outer, lambda p: p[k])))
    boxes = tissue.select("sid", "rings", low("x").alias("__x0"), high("x").alias("__x1"), low("y").alias("__y0"), high("y").alias("__y1")).where("__x0 IS NOT NULL").join(own, "sid")
    spread = lambda lo, hi: F.explode(F.sequence(at(F.col(lo) - F.col("ps")), at(F.col(hi))))
    right = boxes.withColumn("__bx", spread("__x0", "__x1")).withColumn("__by", spread("__y0", "__y1"))
    right = right.select(F.col("sid").alias("__sid"), F.col("ps").alias("__ps"), F.col("__bx").alias("__cx"), F.col("__by").alias("__cy"), "rings")
    names = grid.columns
    schema = grid.schema

    def solve(patches: pa.Table, polygons: pa.Table) -> pa.Table:
        if not polygons.num_rows or not patches.num_rows:
            return patches.select(names).slice(0, 0)
        shapes = []
        for rings in polygons.column("rings").to_pylist():
            points = [np.array([(p["x"], p["y"]) for p in r or [] if p], dtype=float).reshape(-1, 2) for r in rings or []]
            shapes.append(edges([simplified(r, tolerance) for r in points]))
        ps, x, y = (patches.column(c).to_numpy().astype(float) for c in ("ps", "x", "y"))
        boxes = np.stack([x, y, x + ps, y + ps], axis=1).reshape(-1, 4)
        keep, near = located(shapes, boxes)
        open_ = np.nonzero(~keep & near.any(axis=1))[0]
        least = threshold * ps * ps * (1 - 1e-12)
        if threshold > 0 and sum(map(len, shapes)) <= AT_ONCE:
            keep[open_] = union_areas(shapes, boxes[open_]) >= least[open_]
            open_ = open_[:0]
        for i in open_:
            own = [shapes[p] for p in np.nonzero(near[i])[0]]
            keep[i] = touches(own, *boxes[i]) if threshold <= 0 else union_area(own, *boxes[i]) >= least[i]
        return patches.select(names).filter(pa.array(keep, pa.bool_()))

    return left.groupBy("sid", "ps", "__bx", "__by").cogroup(right.groupBy("__sid", "__ps", "__cx", "__cy")).applyInArrow(solve, schema)


def filtered_contours(contours: DataFrame, least_area: float, least_hole: float, most_holes: int) -> DataFrame:
    """Contours (sid, contour_id, parent, area) -> (sid, contour_id, net_area, hole_ids): those
    without a parent (null or -1) whose area without that of their direct children is positive
    and above least_area, with their largest children above least_hole, most_holes at most, by
    falling area, then id."""
    require(contours, "sid", "contour_id", "parent", "area")
    outer = F.coalesce(F.col("parent"), F.lit(-1)) == -1
    kids = contours.where(~outer).select("sid", F.col("parent").alias("contour_id"), F.col("contour_id").alias("hole"), F.col("area").alias("hole_area"))
    ranked = kids.withColumn("r", F.expr("row_number() OVER (PARTITION BY sid, contour_id ORDER BY hole_area DESC, hole)"))
    kept = F.when((F.col("r") <= most_holes) & (F.col("hole_area") > least_hole), F.struct("r", "hole"))
    holes = ranked.groupBy("sid", "contour_id").agg(F.sum("hole_area").alias("holes_area"), F.array_sort(F.collect_list(kept)).alias("holes"))
    net = F.col("area") - F.coalesce("holes_area", F.lit(0.0))
    out = contours.where(outer).join(holes, ["sid", "contour_id"], "left").withColumn("net_area", net)
    ids = F.coalesce(F.transform("holes", lambda h: h["hole"]), F.array().cast(f"array<{dict(contours.dtypes)['contour_id']}>"))
    return out.where((F.col("net_area") > 0) & (F.col("net_area") > least_area)).select("sid", "contour_id", "net_area", ids.alias("hole_ids"))

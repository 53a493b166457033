"""Rings as array<struct<x:double,y:double>>: area, bounds, scaling; expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(ring: Column) -> Column:
    """The area inside a ring (shoelace); it may be closed or not, and turn either way. Fewer than
    three points enclose nothing."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ring[i]["x"] * ring[F.pmod(i + 1, n)]["y"] - ring[F.pmod(i + 1, n)]["x"] * ring[i]["y"])
    return F.when(ring.isNull(), F.lit(None).cast("double")).when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2)


def net_area(exterior: Column, holes: Column) -> Column:
    """The area of a ring without that of its holes."""
    return area(exterior) - F.aggregate(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), F.lit(0.0), lambda s, h: s + area(h))


def bounds(ring: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def scaled(ring: Column, factor: Column) -> Column:
    """Points times a factor, cut off to whole numbers towards zero."""
    return F.transform(ring, lambda p: F.struct((p["x"] * factor).cast("int").alias("x"), (p["y"] * factor).cast("int").alias("y")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))

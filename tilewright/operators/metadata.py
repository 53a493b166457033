"""Resolution of slides: microns per pixel, magnification, and the pyramid level to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import require
from tilewright.functions import text

# Upper bounds of microns per pixel (not included) and their magnification.
BUCKETS = ((0.16, 80), (0.2, 60), (0.3, 40), (0.6, 20), (1.2, 10), (2.4, 5))


def magnification(mpp: Column, strict: bool = True) -> Column:
    """The magnification bucket of microns per pixel; null (and NaN) stay null; 2.4 and more is
    an error if strict, else null."""
    out = F.when(mpp.isNull() | F.isnan(mpp), F.lit(None).cast("int"))
    for below, mag in BUCKETS:
        out = out.when(mpp < below, mag)
    if not strict:
        return out
    return out.otherwise(F.raise_error(F.concat(F.lit("mpp too low a resolution: "), mpp.cast("string"))).cast("int"))


def by_objective(mpp: Column, objective: Column) -> Column:
    """The bucket of mpp, or the objective power as a whole number."""
    return F.coalesce(magnification(mpp, strict=False), objective.try_cast("int"))


def mpp_of(properties: Column, keys: list[str], unit: Column, resolution: Column) -> Column:
    """Microns per pixel from a map of properties: the first key that holds a number, rounded to
    four digits; else from pixels per centimetre or inch; else null."""
    named = F.coalesce(*[F.bround(F.try_element_at(properties, F.lit(k)).try_cast("double"), 4) for k in keys])
    per = F.when(F.lower(unit) == "centimeter", F.lit(10000.0)).when(F.lower(unit) == "inch", F.lit(25400.0))
    return F.coalesce(named, F.bround(F.when(resolution > 0, per / resolution), 4))


# Microns in a unit of length.
MICRONS = {"micrometer": 1.0, "micron": 1.0, "um": 1.0, "µm": 1.0, "nanometer": 1e-3, "nm": 1e-3, "millimeter": 1e3, "mm": 1e3, "centimeter": 1e4, "cm": 1e4, "meter": 1e6, "m": 1e6}


def in_microns(value: Column, unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MICRONS.items() for x in pair])
    return value * F.try_element_at(table, F.lower(unit))


def level_choice(levels: Column, wanted: Column, tolerance: float = 0.01) -> Column:
    """struct<level, factor> for the rising downsamples of a pyramid: the first within the
    tolerance (factor 1); else the last that isn't above `wanted` (factor wanted / level); below
    all of them the first (factor level / wanted). Null without levels."""
    numbered = F.transform(levels, lambda d, i: F.struct(i.alias("level"), d.cast("double").alias("d")))
    exact = F.get(F.filter(numbered, lambda s: F.abs(s["d"] - wanted) <= tolerance), F.lit(0))
    below = F.filter(numbered, lambda s: s["d"] <= wanted)
    last = F.get(below, F.size(below) - 1)
    first = F.get(F.filter(numbered, lambda s: s["d"] >= wanted), F.lit(0))
    pick = lambda s, f: F.struct(s["level"].alias("level"), f.cast("double").alias("factor"))
    return F.when(exact.isNotNull(), pick(exact, F.lit(1.0))).when(last.isNotNull(), pick(last, wanted / last["d"])).when(first.isNotNull(), pick(first, first["d"] / wanted))


def synthetic_pyramid(width: Column, height: Column, smallest: int = 512) -> Column:
    """Downsamples 1, 2, 4, ... of a slide without a pyramid, until its shorter side is at most
    `smallest`."""
    side = F.least(width, height)
    times = F.size(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda i: side > F.lit(float(smallest)) * F.pow(F.lit(2.0), i)))
    return F.transform(F.sequence(F.lit(0), times), lambda i: F.pow(F.lit(2.0), i))


def last_of(lookup: DataFrame, key: str, value: str, order: str, first: bool = False) -> DataFrame:
    """(key, value): of the rows of a key the last by `order`, or the first; null keys are none."""
    require(lookup, key, value, order)
    pick = F.min_by if first else F.max_by
    return lookup.where(F.col(key).isNotNull()).groupBy(key).agg(pick(value, order).alias(value))


def with_lookup(slides: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """slides with the value of their key, null where the lookup has none. The lookup is unique by
    key; whether it is broadcast is left to the optimizer, which knows its size."""
    return slides.join(lookup.select(key, value), key, "left")


def mismatch(embedded: Column, given: Column, tolerance: float = 1e-3) -> Column:
    return F.coalesce(F.abs(embedded - given) > tolerance, F.lit(False))


def listed_slides(paths: DataFrame, extensions: tuple[str, ...] = tuple(sorted({e for r in text.READERS.values() for e in r}))) -> DataFrame:
    """paths (path) of slides, with slide_id, name, ext and reader, in order of path."""
    require(paths, "path")
    path = F.col("path")
    kept = paths.where(text.has_extension(path, extensions)).select("path").distinct()
    return kept.select("path", text.slide_id(path).alias("slide_id"), text.stem(path).alias("name"), text.extension(path).alias("ext"), text.reader(path).alias("reader"))


def conversion_plan(files: DataFrame, table: DataFrame, supported: tuple[str, ...], zoom: float = 1.0) -> DataFrame:
    """files (name) and table (name, mpp, row): what to convert, with the resolution of the output;
    `plan` is task, missing (no row, or one without mpp) or unsupported. Of several rows the
    first counts."""
    require(files, "name")
    known = last_of(table.where(F.col("mpp").isNotNull()), "name", "mpp", "row", first=True)
    plan = F.when(~text.has_extension(F.col("name"), supported), "unsupported").when(F.col("mpp").isNull(), "missing").otherwise("task")
    out = files.select("name").distinct().join(known, "name", "left")
    return out.select("name", plan.alias("plan"), F.when(plan == "task", F.col("mpp") / zoom).alias("output_mpp"))


def first_two(flat: Column, keys: list[str]) -> Column:
    """Microns per pixel from flattened metadata (map of dotted keys): the mean of the first two
    keys, in the order given, that hold a number; the only one if there is one; else null."""
    hits = F.filter(F.array(*[F.try_element_at(flat, F.lit(k)).try_cast("double") for k in keys]), lambda v: v.isNotNull())
    return F.when(F.size(hits) >= 2, (F.get(hits, F.lit(0)) + F.get(hits, F.lit(1))) / 2).otherwise(F.get(hits, F.lit(0)))


def of_scaling(x_metres: Column, y_metres: Column) -> Column:
    """Microns per pixel from the lengths of a pixel in metres: their mean."""
    return (x_metres + y_metres) / 2 * 1e6


def embedded(pixels_per_mm: Column, physical: Column) -> Column:
    """Microns per pixel that a file itself states: from its resolution, else its physical size."""
    return F.coalesce(F.when(pixels_per_mm > 0, 1000 / pixels_per_mm), physical)


def pixels_per_cm(mpp: Column) -> Column:
    """The resolution that a written file states; null unless mpp is positive."""
    return F.when(mpp > 0, 1 / (mpp * F.lit(1e-4)))


def level_ratio(width: Column, height: Column, level_width: Column, level_height: Column) -> Column:
    """struct<downsample, uneven>: mean of the ratios of both sides, and whether these differ by
    more than a thousandth."""
    x, y = width / F.nullif(level_width, F.lit(0)), height / F.nullif(level_height, F.lit(0))
    return F.struct(((x + y) / 2).alias("downsample"), (F.abs(x - y) > 1e-3 * F.abs(y)).alias("uneven"))


def thumbnail_size(width: Column, height: Column, long_edge: int = 1000) -> Column:
    """struct<w, h>: the longer side as given, the other in proportion, cut off."""
    other = lambda short, long: (F.lit(long_edge) * short / F.nullif(long, F.lit(0))).cast("int")
    wide = width > height
    return F.struct(F.when(wide, F.lit(long_edge)).otherwise(other(width, height)).alias("w"), F.when(wide, other(height, width)).otherwise(F.lit(long_edge)).alias("h"))


def workers(cores: int, at_most: int | None = None, batch: int | None = None) -> int:
    """Three quarters of the cores, at least one, at most `at_most` (or twice the batch); 0 if at_most
    is 0 or less."""
    if at_most is not None and at_most <= 0:
        return 0
    limit = at_most if at_most is not None else 2 * batch if batch else cores
    return max(1, min(int(0.75 * cores), limit))

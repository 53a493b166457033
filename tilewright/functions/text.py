"""Names, paths and labels of slides, grids and patches, as column expressions.

Null stays null in all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of two parts, and the formats that each reader takes.
COMPOUND = (".ome.tif", ".ome.tiff", ".ome.zarr")
READERS = {
    "openslide": (".svs", ".tif", ".tiff", ".ndpi", ".vms", ".vmu", ".scn", ".mrxs", ".dcm"),
    "cucim": (".svs", ".tif", ".tiff"),
    "sdpc": (".sdpc",),
    "image": (".png", ".jpg", ".jpeg"),
    "omezarr": (".zarr",),
    "czi": (".czi",),
}
#: Without an explicit reader, the first of these that takes the extension; else image.
AUTOMATIC = ("openslide", "sdpc", "omezarr", "czi")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_extension(path: Column) -> Column:
    """From the last dot on, in the case it has; leading dots of a name open no extension."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def extension(path: Column) -> Column:
    """last_extension(), but extensions of two parts stay whole, whatever their case."""
    two = F.regexp_extract(path, r"(?i)(\.ome\.(?:tiff?|zarr))$", 1)
    return F.when(two != "", two).otherwise(last_extension(path))


def stem(path: Column) -> Column:
    """The name without its extension."""
    base = basename(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(path)))


def has_extension(path: Column, wanted: tuple[str, ...]) -> Column:
    low = F.lower(path)
    found = F.lit(False)
    for e in wanted:
        found = found | low.endswith(e)
    return found


def reader(path: Column, explicit: Column | None = None) -> Column:
    """The reader of a slide by the last part of its extension; an explicit one that doesn't take
    it, or that there isn't, is an error. openslide and image, if explicit, take any."""
    ext = F.lower(last_extension(path))
    chosen = F.when(path.isNull(), F.lit(None).cast("string"))
    for name in AUTOMATIC:
        chosen = chosen.when(ext.isin(*READERS[name]), F.lit(name))
    chosen = chosen.otherwise(F.lit("image"))
    if explicit is None:
        return chosen
    given = F.when(explicit.isin("openslide", "image"), explicit)
    for name in ("sdpc", "cucim", "omezarr", "czi"):
        given = given.when((explicit == name) & ext.isin(*READERS[name]), explicit)
    given = given.when(explicit.isNotNull(), F.raise_error(F.concat(F.lit("reader "), explicit, F.lit(" does not take "), ext)).cast("string"))
    return F.coalesce(given, chosen)


def slide_id(path: Column) -> Column:
    """Name with extension, two underscores and twelve hexadecimal digits of the path's SHA-1."""
    return F.concat(basename(path), F.lit("__"), F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 12))


def magnification_text(mag: Column) -> Column:
    """Whole magnifications without decimals, others with six significant digits at most."""
    whole = mag == F.floor(mag)
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(mag), F.lit(1e-4)))).cast("int"))
    rounded = F.round(mag * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.when(whole, F.floor(mag).cast("string")).otherwise(F.regexp_replace(rounded.cast("string"), r"\.0$", ""))


def grid_folder(mag: Column, patch_size: Column, overlap: Column) -> Column:
    return F.concat(magnification_text(mag), F.lit("x_"), patch_size.cast("string"), F.lit("px_"), overlap.cast("string"), F.lit("px_overlap"))


def patch_file(idx: Column, x: Column, y: Column, kind: str = "png") -> Column:
    """Name of a dumped patch: its place in six digits at least, x and y."""
    if kind not in ("png", "jpg", "jpeg"):
        raise ValueError(f"unknown format: {kind}")
    return F.format_string(f"%06d_x%d_y%d.{kind}", idx, x, y)


def task_parts(task: Column) -> tuple[Column, Column]:
    """(group, encoder) of a task: what is before and after its first colon; encoder may be null."""
    parts = F.split(task, ":", 2)
    return parts[0], F.get(parts, F.lit(1))


def is_path(text: Column) -> Column:
    return F.coalesce(text.contains("/") | text.startswith(".") | text.startswith("~"), F.lit(False))


def without_suffix(text: Column, suffix: str = "_patches") -> Column:
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def shortened(text: Column, length: int = 200) -> Column:
    """One line of at most `length` characters, and an ellipsis if it had more."""
    line = F.btrim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length), F.lit("…"))).otherwise(line)

"""Slide listings, slide lists, polygons and state documents as tables, and back to files."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import require
from tilewright.functions import text
from tilewright.operators.metadata import last_of, listed_slides

ALL = tuple(sorted({e for r in text.READERS.values() for e in r}))


def slide_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ALL, nested: bool = False) -> DataFrame:
    """(path, rel_path, bytes, modified): files of the folder (and those under it, if nested) with
    one of the extensions, in any case. Contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower()).load(folder)
    at = folder.rstrip("/").removeprefix("file:") + "/"
    path = F.regexp_replace("path", "^file:(//)?", "")
    rows = files.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(text.has_extension(F.col("path"), extensions))
    return rows.select("path", F.when(F.col("path").startswith(at), F.substring("path", F.lit(len(at) + 1), F.length("path"))).otherwise(text.basename(F.col("path"))).alias("rel_path"), "bytes", "modified")


def slide_list(spark: SparkSession, csv: str, files: DataFrame | None = None) -> DataFrame:
    """(wsi, mpp) of a slide list with the column wsi and perhaps mpp; rows without wsi are left
    out. If files (rel_path) are given, a listed slide that isn't among them is an error."""
    rows = spark.read.option("header", True).csv(csv)
    if "wsi" not in rows.columns:
        raise ValueError("the slide list needs the column wsi")
    mpp = F.col("mpp").try_cast("double") if "mpp" in rows.columns else F.lit(None).cast("double")
    out = rows.where("wsi IS NOT NULL").select("wsi", F.nanvl(mpp, F.lit(None).cast("double")).alias("mpp"))
    if files is not None:
        missing = out.join(files.select(F.col("rel_path").alias("wsi")), "wsi", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"listed, but not there: {missing[0]['wsi']}")
    return out


def slides_with_mpp(files: DataFrame, listed: DataFrame) -> DataFrame:
    """files (path, rel_path) joined with the mpp of a slide list; its last row of a slide counts."""
    lookup = last_of(listed.withColumn("__row", F.monotonically_increasing_id()), "wsi", "mpp", "__row")
    return listed_slides(files).join(files.select("path", "rel_path"), "path").join(lookup.withColumnRenamed("wsi", "rel_path"), "rel_path", "left")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(tissue_id, rings) of GeoJSON files: polygons, and each part of multipolygons; other shapes
    are none."""
    schema = "features array<struct<properties:struct<tissue_id:bigint>,geometry:string>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("i", "f"))
    shape = lambda t: F.from_json("f.geometry", f"struct<type:string,coordinates:{t}>")
    rows = features.select("i", "f", shape("array<array<array<double>>>").alias("one"), shape("array<array<array<array<double>>>>").alias("many"))
    each = F.when(F.col("one.type") == "Polygon", F.array("one.coordinates")).when(F.col("many.type") == "MultiPolygon", F.col("many.coordinates"))
    parts = rows.select(F.coalesce("f.properties.tissue_id", "i").alias("tissue_id"), F.explode(each).alias("p"))
    ring = lambda r: F.transform(F.filter(r, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return parts.select("tissue_id", F.transform("p", ring).alias("rings"))


def geojson(rows: DataFrame) -> DataFrame:
    """(sid, value): polygons (sid, tissue_id, rings) as one GeoJSON document a slide."""
    require(rows, "sid", "tissue_id", "rings")
    coordinates = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("tissue_id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    grouped = rows.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("tissue_id", feature.alias("f")))).alias("fs"))
    return grouped.select("sid", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda f: f["f"]).alias("features"))).alias("value"))


def state_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(state_id, file_name, raw) of the JSON files of a folder, as nested.shred() takes them;
    those that can't be read as a state have no rows there."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    return files.select(F.xxhash64("file_name").alias("state_id"), "file_name", "raw")


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet by partition, rows of one together; overwriting replaces the partitions that df
    has and leaves the others. The commit protocol makes it atomic per job."""
    df.repartition(*by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _plain(value: object) -> object:
    """A value as JSON takes it: numbers of numpy as numbers, ranges as lists, types and functions
    by their name, anything else as text."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, (range, set, frozenset, tuple)):
        return list(value)
    return getattr(value, "__name__", None) or str(value)


def write_atomically(path: str, content: str) -> None:
    """A file of the driver's file system that is there as a whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def snapshot(settings: dict, ignored: tuple[str, ...] = ()) -> str:
    """Settings as JSON, without those that are ignored or private."""
    return json.dumps({k: v for k, v in settings.items() if k not in ignored and not k.startswith("_")}, default=_plain, indent=2, sort_keys=True)


def start_run(folder: str, tool: str, settings: dict) -> str:
    """A new run's manifest in folder/runs; its id."""
    run = uuid.uuid4().hex[:12]
    manifest = {"run_id": run, "tool": tool, "started_at": time.time(), "finished_at": None, "status": "running", "error": None, "host": os.uname().nodename, "pid": os.getpid(), "args": json.loads(snapshot(settings))}
    write_atomically(f"{folder}/runs/{run}.json", json.dumps(manifest, indent=2))
    return run


def finish_run(folder: str, run: str, report: str, error: str | None = None) -> None:
    """Close a manifest and add the report to folder/summary.md."""
    path = f"{folder}/runs/{run}.json"
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    manifest |= {"finished_at": time.time(), "status": "error" if error else "completed", "error": error}
    write_atomically(path, json.dumps(manifest, indent=2))
    before = ""
    if os.path.exists(f"{folder}/summary.md"):
        with open(f"{folder}/summary.md", encoding="utf-8") as f:
            before = f.read() + "\n"
    write_atomically(f"{folder}/summary.md", f"{before}## Run {run}: {manifest['status']}\n\n{report}\n")

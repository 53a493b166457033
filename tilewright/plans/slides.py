"""Queries on slides, grids and tissue, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import table
from tilewright.functions import geometry, maps, text, udtf
from tilewright.operators import grid, metadata, polygons


def _listings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per listing of a slide."""
    return table(spark, d, "slides").where("listing_id IS NOT NULL").select("listing_id", *columns).dropDuplicates(["listing_id"])


def _grids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "patch_grids").where("id IS NOT NULL").dropDuplicates(["id"])
    way = "patch_size_level0 - CAST(bround(CAST(overlap AS DOUBLE) * patch_size_level0 / patch_size) AS BIGINT)"
    return rows.selectExpr("id AS sid", "level0_width AS w", "level0_height AS h", "CAST(patch_size_level0 AS BIGINT) AS ps", f"{way} AS step", "target_magnification", "level0_magnification", "patch_size", "overlap")


def mag_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d, "mpp", "mag")
    bucket = metadata.magnification(F.col("mpp"), strict=False)
    return rows.select("listing_id", bucket.alias("bucket"), (F.bround(F.lit(10.0) / F.col("mag"), 4)).alias("nominal_mpp"), metadata.mismatch(F.lit(10.0) / F.col("mag"), F.col("mpp")).alias("differs"))


def mpp_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    named = F.when(F.col("event_id") % 2 == 0, F.from_json("props", "map<string,string>")).otherwise(F.create_map().cast("map<string,string>"))
    unit = F.when(F.col("event_id") % 3 == 0, "Centimeter").when(F.col("event_id") % 3 == 1, "inch")
    return e.select("event_id", metadata.mpp_of(named, ["mpp", "k"], unit, (F.col("event_id") % 97).cast("double") * 100).alias("mpp"), maps.first_number(F.col("props"), ["$.mpp", "$.k"]).alias("first_number"))


def level_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d, "level_count")
    levels = F.transform(F.sequence(F.lit(0), F.col("level_count") - 1), lambda i: F.pow(F.lit(4.0), i))
    pick = metadata.level_choice(levels, (F.col("listing_id") % 80) / 2 + 0.5)
    return rows.where("level_count > 0").select("listing_id", pick.alias("p")).select("listing_id", F.col("p.level").alias("level"), F.round("p.factor", 6).alias("factor"))


def synthetic_pyramid(spark: SparkSession, d: str) -> DataFrame:
    levels = metadata.synthetic_pyramid(F.col("width"), F.col("height"))
    return _listings(spark, d, "width", "height").select("listing_id", F.size(levels).alias("n_levels"), F.array_max(levels).alias("last"))


def slide_names(spark: SparkSession, d: str) -> DataFrame:
    return metadata.listed_slides(table(spark, d, "slides").select(F.col("slide_path").alias("path")))


def fmt_names(spark: SparkSession, d: str) -> DataFrame:
    small = text.magnification_text(F.col("level0_magnification") / 16)
    return _grids(spark, d).select("sid", text.grid_folder(F.col("target_magnification"), F.col("patch_size"), F.col("overlap")).alias("folder"), small.alias("small"))


def patch_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "patch_coords").where("patch_id IS NOT NULL").select("patch_id", "patch_idx", "coords").dropDuplicates(["patch_id"])
    x, y = F.get("coords", F.lit(0)), F.get("coords", F.lit(1))
    return rows.where(x.isNotNull() & y.isNotNull() & F.col("patch_idx").isNotNull()).select("patch_id", text.patch_file(F.col("patch_idx"), x, y).alias("file"))


def mpp_join(spark: SparkSession, d: str) -> DataFrame:
    lookup = metadata.last_of(_listings(spark, d, "id", "mpp"), "id", "mpp", "listing_id")
    rows = metadata.with_lookup(_grids(spark, d).withColumnRenamed("sid", "id"), lookup, "id", "mpp")
    return rows.select("id", "mpp", metadata.mismatch(F.lit(10.0) / F.col("level0_magnification"), F.col("mpp")).alias("differs"))


def convert_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d, "name", "ext", "mpp").select(F.concat("name", "ext").alias("name"), "mpp", F.col("listing_id").alias("row"))
    return metadata.conversion_plan(rows, rows.where("row % 5 <> 0"), (".svs", ".tif", ".tiff", ".ndpi", ".mrxs", ".png", ".jpg", ".czi"), 0.5)


def _slides(spark: SparkSession, d: str) -> DataFrame:
    """F-SLIDES."""
    return table(spark, d, "supplier").selectExpr("s_suppkey AS sid", "2000 + 10 * (s_suppkey * 137 % 300) AS w", "1500 + 10 * (s_suppkey * 89 % 250) AS h", "(10 + (s_suppkey % 23) * 10) / 100.0D AS mpp")


def _tissue(slides: DataFrame) -> DataFrame:
    """F-TISSUE: three rectangles a slide."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("tissue_id"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(((1, 4), (3, 7), (6, 9))))))
    return slides.select("sid", "w", "h", parts.alias("r")).selectExpr("sid", "r.tissue_id", "w * r.a div 10 AS x0", "h * r.a div 10 AS y0", "w * r.b div 10 AS x1", "h * r.b div 10 AS y1")


def grid_coords(spark: SparkSession, d: str) -> DataFrame:
    return grid.patches(_slides(spark, d)).select("sid", "x", "y")


def grid_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Grids with overlap, with column, row and place of each patch."""
    placed = grid.scan_order(grid.patches(_grids(spark, d)))
    return placed.select("sid", "x", "y", F.floor(F.col("x") / F.col("step")).alias("col"), F.floor(F.col("y") / F.col("step")).alias("row"), "patch_idx")


def col_row_inverse(spark: SparkSession, d: str) -> DataFrame:
    col, row = grid.column_row(F.col("x"), F.col("y"), F.col("ps"), F.col("step"))
    return grid.patches(_slides(spark, d), 512, 20, 64).select("sid", "x", "y", col.alias("col"), row.alias("row"))


def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """How far apart patches that follow each other are, rows weighing ten times, in either order."""
    slides, out = grid.spread(_slides(spark, d)), None
    for name in ("row-major", "col-major"):
        rows = grid.scan_order(grid.patches(slides).hint("merge"), name)
        before = "OVER (PARTITION BY sid ORDER BY patch_idx)"  # slides are dealt out already, so no patch is moved
        rows = rows.selectExpr("sid", "x", "y", f"lag(x) {before} AS bx", f"lag(y) {before} AS by").where("bx IS NOT NULL")
        far = rows.groupBy("sid").agg(F.sum(F.abs(F.col("x") - F.col("bx")) + 10 * F.abs(F.col("y") - F.col("by"))).alias("distance"))
        far = far.select("sid", F.lit(name).alias("scan_order"), "distance")
        out = far if out is None else out.unionByName(far)
    return out


def tissue_any(spark: SparkSession, d: str) -> DataFrame:
    slides = grid.spread(_slides(spark, d))
    return grid.touching_rectangles(grid.patches(slides), _tissue(slides), grid.sized(slides)).select("sid", "x", "y")


def tissue_prop(spark: SparkSession, d: str) -> DataFrame:
    slides = grid.spread(_slides(spark, d))
    return grid.on_rectangles(grid.patches(slides), _tissue(slides), 25, grid.sized(slides)).select("sid", "x", "y", "area")


def tissue_patch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Patches kept by the spatial semi-join at a quarter of tissue, per slide."""
    slides = grid.spread(_slides(spark, d))
    return grid.on_rectangles(grid.patches(slides), _tissue(slides), 25, grid.sized(slides)).groupBy("sid").agg(F.count("*").alias("n_patches"))


def tissue_polygons(spark: SparkSession, d: str) -> DataFrame:
    """tissue_prop() with the rectangles as polygons, by the general semi-join."""
    slides = grid.spread(_slides(spark, d))
    rings = F.array(geometry.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    tissue = _tissue(slides).select("sid", "tissue_id", rings.alias("rings"))
    return polygons.on_polygons(grid.patches(slides), tissue, 0.25, sizes=grid.sized(slides)).select("sid", "x", "y")


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    """Area and bounds of slides as rings, with a triangle as a hole."""
    g = _grids(spark, d)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, w, h = F.lit(0.0), F.col("w"), F.col("h")
    hole = F.array(corner(zero, zero), corner(w / 2, zero), corner(zero, h / 2))
    ring = geometry.rectangle(zero, zero, w, h)
    return g.select("sid", geometry.area(ring).alias("area"), F.round(geometry.net_area(ring, F.array(hole)), 3).alias("net_area"), geometry.bounds(geometry.scaled(ring, F.lit(0.1)))["x1"].cast("long").alias("scaled_x1"))


def contour_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey div 70 AS sid", "p_partkey AS contour_id", "IF(p_partkey % 7 = 0, -1, p_partkey - p_partkey % 7) AS parent", "CAST(IF(p_partkey % 7 = 0, p_size * 20, p_size) AS DOUBLE) AS area")
    return polygons.filtered_contours(p, 300.0, 12.0, 3).select("sid", "contour_id", "net_area", F.array_join(F.col("hole_ids").cast("array<string>"), ",").alias("hole_ids"))


def id_filter(spark: SparkSession, d: str) -> DataFrame:
    """Kept ids less excluded ones, as a semi-join and an anti-join."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    keep = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    exclude = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber > 4").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(keep, "p_partkey", "left_semi").join(exclude, "p_partkey", "left_anti")


def thumb_sizes(spark: SparkSession, d: str) -> DataFrame:
    size = metadata.thumbnail_size(F.col("w"), F.col("h"))
    small = grid.drawn(F.col("w"), F.col("h"), F.col("ps"), F.greatest("w", "h") / F.lit(1000.0))
    return _grids(spark, d).where("w > 0 AND h > 0").select("sid", size.alias("t"), small["side"].alias("side")).select("sid", "t.w", "t.h", "side")


def level_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d).where("w > 64 AND h > 64")
    ratio = metadata.level_ratio(F.col("w"), F.col("h"), F.floor(F.col("w") / 4), F.floor(F.col("h") / 4))
    return g.select("sid", ratio.alias("r")).select("sid", F.round("r.downsample", 6).alias("downsample"), "r.uneven")


def file_mpp(spark: SparkSession, d: str) -> DataFrame:
    """Resolutions as files state them: flattened metadata, pixels per length, scaling."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"Scan": {"X": '), (F.col("event_id") % 7 / 8.0).cast("string"), F.lit(', "y": '), F.when(F.col("event_id") % 3 > 0, "0.5").otherwise('"none"'), F.lit("}}")).alias("json"))
    flat = metadata.first_two(maps.leaves(F.col("json")), ["scan.x", "scan.y", "scan.z"])
    per_mm = (F.col("event_id") % 5 * 500).cast("double")
    out = e.withColumn("mpp", flat)
    return out.select("event_id", "mpp", metadata.embedded(per_mm, F.col("mpp")).alias("embedded"), F.round(metadata.pixels_per_cm(F.col("mpp")), 3).alias("per_cm"), F.round(metadata.of_scaling(F.col("mpp") / 1e6, F.lit(5e-7)), 6).alias("scaling"))


def legacy_coords(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "patch_coords").where("patch_id IS NOT NULL").select("patch_id", "patch_size_level0").dropDuplicates(["patch_id"])
    old = rows.selectExpr("patch_id", "patch_size_level0 div 4 AS patch_size", "CAST(patch_id % 3 AS INT) AS patch_level", "IF(patch_id % 2 = 0, NULL, 1.5D) AS custom_downsample")
    return grid.from_legacy(old, F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0))).select("patch_id", "ratio", "patch_size_level0")


def udtf_grid(spark: SparkSession, d: str) -> DataFrame:
    """grid_coords() by the table function."""
    udtf.register(spark)
    grid.sized(_slides(spark, d)).createOrReplaceTempView("udtf_grid_slides")
    return spark.sql("SELECT sid, x, y FROM udtf_grid_slides, LATERAL patch_grid(CAST(w AS BIGINT), CAST(h AS BIGINT), ps, step)")


QUERIES = {
    f.__name__: f
    for f in (
        mag_bucket, mpp_coalesce, level_choice, synthetic_pyramid, slide_names, fmt_names, patch_names, mpp_join, convert_plan, grid_coords, grid_overlap, col_row_inverse, scan_order,
        tissue_any, tissue_prop, tissue_patch_counts, tissue_polygons, polygon_area, contour_filter, id_filter, thumb_sizes, level_ratios, file_mpp, legacy_coords, udtf_grid,
    )
}

_BUCKET = "CASE WHEN mpp < 0.16 THEN 80 WHEN mpp < 0.2 THEN 60 WHEN mpp < 0.3 THEN 40 WHEN mpp < 0.6 THEN 20 WHEN mpp < 1.2 THEN 10 WHEN mpp < 2.4 THEN 5 END"
_LISTED = "WITH l AS (SELECT DISTINCT ON (listing_id) * FROM slides WHERE listing_id IS NOT NULL)\n"
_GRIDS = """WITH g AS (SELECT DISTINCT ON (id) id AS sid, level0_width AS w, level0_height AS h, CAST(patch_size_level0 AS BIGINT) AS ps, patch_size_level0 - CAST(round_even(CAST(overlap AS DOUBLE) * patch_size_level0 / patch_size, 0) AS BIGINT) AS step,
  target_magnification, level0_magnification, patch_size, overlap FROM patch_grids WHERE id IS NOT NULL)
"""


def _grid_sql(overlap: int = 0) -> str:
    return f"""
WITH s AS (SELECT s_suppkey AS sid, 2000 + 10 * (s_suppkey * 137 % 300) AS w, 1500 + 10 * (s_suppkey * 89 % 250) AS h, (10 + (s_suppkey % 23) * 10) / 100.0::DOUBLE AS mpp FROM supplier),
k AS (SELECT *, {_BUCKET} / 20.0::DOUBLE AS factor FROM s),
m AS (SELECT *, CAST(round_even(512 * factor, 0) AS BIGINT) AS ps, CAST(round_even(512 * factor, 0) AS BIGINT) - CAST(round_even({overlap} * factor, 0) AS BIGINT) AS step FROM k),
c AS (SELECT sid, w, h, ps, step, unnest(range(0, w, step)) AS x FROM m),
g AS (SELECT sid, w, h, ps, step, x, unnest(range(0, h, step)) AS y FROM c)
"""


_SIDE = "greatest(0, least({p} + ps, {s} * {b} // 10) - greatest({p}, {s} * {a} // 10))"


def _area(a: int, b: int) -> str:
    return f"({_SIDE.format(p='x', s='w', a=a, b=b)} * {_SIDE.format(p='y', s='h', a=a, b=b)})"


_UNION = f"({_area(1, 4)} + {_area(3, 7)} + {_area(6, 9)} - {_area(3, 4)} - {_area(6, 7)})"
_TOUCH = " OR ".join(f"(x <= w * {b} // 10 AND x + ps >= w * {a} // 10 AND y <= h * {b} // 10 AND y + ps >= h * {a} // 10)" for a, b in ((1, 4), (3, 7), (6, 9)))

SQL = {
    "mag_bucket": _LISTED + f"SELECT listing_id, {_BUCKET} AS bucket, round_even(10.0::DOUBLE / mag, 4) AS nominal_mpp, coalesce(abs(10.0::DOUBLE / mag - mpp) > 1e-3, false) AS differs FROM l",
    "mpp_coalesce": """WITH e AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id % 97 * 100.0::DOUBLE AS res, CASE event_id % 3 WHEN 0 THEN 10000.0::DOUBLE WHEN 1 THEN 25400.0::DOUBLE END AS per FROM events)
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN round_even(k, 4) END, round_even(CASE WHEN res > 0 THEN per / res END, 4)) AS mpp, round_even(k, 4) AS first_number FROM e""",
    "level_choice": _LISTED
    + """, v AS (SELECT listing_id, listing_id % 80 / 2.0::DOUBLE + 0.5 AS wanted, unnest(range(0, level_count)) AS level FROM l WHERE level_count > 0),
d AS (SELECT *, pow(4.0::DOUBLE, level) AS d FROM v),
a AS (SELECT listing_id, wanted, min(level) FILTER (WHERE abs(d - wanted) <= 0.01) AS e, max(level) FILTER (WHERE d <= wanted) AS b, min(level) FILTER (WHERE d >= wanted) AS f FROM d GROUP BY 1, 2)
SELECT listing_id, CAST(coalesce(e, b, f) AS INTEGER) AS level, round(CASE WHEN e IS NOT NULL THEN 1.0 WHEN b IS NOT NULL THEN wanted / pow(4.0::DOUBLE, b) ELSE pow(4.0::DOUBLE, f) / wanted END, 6) AS factor FROM a""",
    "synthetic_pyramid": _LISTED + ", n AS (SELECT listing_id, len(list_filter(range(0, 41), lambda i: least(width, height) > 512 * pow(2.0::DOUBLE, i))) AS t FROM l) SELECT listing_id, CAST(t + 1 AS INTEGER) AS n_levels, pow(2.0::DOUBLE, t) AS last FROM n",
    "slide_names": r"""WITH p AS (SELECT DISTINCT slide_path AS path, split_part(slide_path, '/', -1) AS base FROM slides WHERE regexp_matches(lower(slide_path), '\.(svs|tif|tiff|ndpi|vms|vmu|scn|mrxs|dcm|sdpc|png|jpg|jpeg|zarr|czi)$')),
e AS (SELECT *, regexp_extract(path, '(?i)(\.ome\.(?:tiff?|zarr))$', 1) AS two, regexp_extract(base, '^\.*[^.].*?(\.[^.]*)$', 1) AS one FROM p),
x AS (SELECT *, CASE WHEN two <> '' THEN two ELSE one END AS ext FROM e)
SELECT path, base || '__' || substr(sha1(path), 1, 12) AS slide_id, substr(base, 1, length(base) - length(ext)) AS name, ext,
  CASE WHEN lower(one) IN ('.svs', '.tif', '.tiff', '.ndpi', '.vms', '.vmu', '.scn', '.mrxs', '.dcm') THEN 'openslide' WHEN lower(one) = '.sdpc' THEN 'sdpc' WHEN lower(one) = '.zarr' THEN 'omezarr' WHEN lower(one) = '.czi' THEN 'czi' ELSE 'image' END AS reader FROM x""",
    "fmt_names": _GRIDS + "SELECT sid, format('{:g}', target_magnification) || 'x_' || patch_size || 'px_' || overlap || 'px_overlap' AS folder, format('{:g}', level0_magnification / 16) AS small FROM g",
    "patch_names": "WITH p AS (SELECT DISTINCT ON (patch_id) patch_id, patch_idx, coords FROM patch_coords WHERE patch_id IS NOT NULL) SELECT patch_id, printf('%06d_x%d_y%d.png', patch_idx, coords[1], coords[2]) AS file FROM p WHERE coords[1] IS NOT NULL AND coords[2] IS NOT NULL AND patch_idx IS NOT NULL",
    "mpp_join": _GRIDS + ", l AS (SELECT id, arg_max(struct_pack(m := mpp), listing_id).m AS mpp FROM slides WHERE listing_id IS NOT NULL AND id IS NOT NULL GROUP BY 1) SELECT g.sid AS id, l.mpp, coalesce(abs(10.0::DOUBLE / level0_magnification - l.mpp) > 1e-3, false) AS differs FROM g LEFT JOIN l ON g.sid = l.id",
    "convert_plan": _LISTED
    + r""", f AS (SELECT name || ext AS name, mpp, listing_id FROM l),
t AS (SELECT name, arg_min(mpp, listing_id) AS mpp FROM f WHERE mpp IS NOT NULL AND listing_id % 5 <> 0 GROUP BY 1),
p AS (SELECT name, mpp, CASE WHEN NOT regexp_matches(lower(name), '\.(svs|tif|tiff|ndpi|mrxs|png|jpg|czi)$') THEN 'unsupported' WHEN mpp IS NULL THEN 'missing' ELSE 'task' END AS plan FROM (SELECT DISTINCT name FROM f) LEFT JOIN t USING (name))
SELECT name, plan, CASE WHEN plan = 'task' THEN mpp / 0.5 END AS output_mpp FROM p""",
    "grid_coords": _grid_sql() + "SELECT sid, x, y FROM g",
    "grid_overlap": _GRIDS
    + """, c AS (SELECT sid, h, step, unnest(range(0, w, step)) AS x FROM g WHERE step > 0 AND ps > 0), d AS (SELECT sid, step, x, unnest(range(0, h, step)) AS y FROM c)
SELECT sid, x, y, CAST(x / step AS BIGINT) AS col, CAST(y / step AS BIGINT) AS row, row_number() OVER (PARTITION BY sid ORDER BY y, x) - 1 AS patch_idx FROM d""",
    "col_row_inverse": _grid_sql(64) + "SELECT sid, x, y, CASE WHEN x = 0 THEN 0 ELSE CAST(floor((x - ps) / step) AS BIGINT) + 1 END AS col, CASE WHEN y = 0 THEN 0 ELSE CAST(floor((y - ps) / step) AS BIGINT) + 1 END AS row FROM g",
    "scan_order": _grid_sql()
    + """, r AS (SELECT sid, 'row-major' AS scan_order, abs(x - lag(x) OVER (PARTITION BY sid ORDER BY y, x)) + 10 * abs(y - lag(y) OVER (PARTITION BY sid ORDER BY y, x)) AS v FROM g
UNION ALL SELECT sid, 'col-major', abs(x - lag(x) OVER (PARTITION BY sid ORDER BY x, y)) + 10 * abs(y - lag(y) OVER (PARTITION BY sid ORDER BY x, y)) FROM g)
SELECT sid, scan_order, CAST(sum(v) AS BIGINT) AS distance FROM r WHERE v IS NOT NULL GROUP BY 1, 2""",
    "tissue_any": _grid_sql() + f"SELECT sid, x, y FROM g WHERE {_TOUCH}",
    "tissue_prop": _grid_sql() + f"SELECT sid, x, y, CAST({_UNION} AS BIGINT) AS area FROM g WHERE 4 * {_UNION} >= ps * ps",
    "tissue_patch_counts": _grid_sql() + f"SELECT sid, count(*) AS n_patches FROM g WHERE 4 * {_UNION} >= ps * ps GROUP BY sid",
    "tissue_polygons": _grid_sql() + f"SELECT sid, x, y FROM g WHERE 4 * {_UNION} >= ps * ps",
    "polygon_area": _GRIDS + "SELECT sid, CAST(w AS DOUBLE) * h AS area, round(CAST(w AS DOUBLE) * h - CAST(w AS DOUBLE) * h / 8, 3) AS net_area, CAST(trunc(w * 0.1::DOUBLE) AS BIGINT) AS scaled_x1 FROM g",
    "contour_filter": """WITH p AS (SELECT p_partkey // 70 AS sid, p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey - p_partkey % 7 END AS parent, CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size * 20 ELSE p_size END AS DOUBLE) AS area FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY sid, parent ORDER BY area DESC, id) AS r FROM p WHERE parent <> -1),
h AS (SELECT sid, parent, sum(area) AS area, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 3 AND area > 12), '') AS hole_ids FROM k GROUP BY 1, 2)
SELECT p.sid, p.id AS contour_id, p.area - coalesce(h.area, 0) AS net_area, coalesce(h.hole_ids, '') AS hole_ids FROM p LEFT JOIN h ON p.sid = h.sid AND p.id = h.parent WHERE p.parent = -1 AND p.area - coalesce(h.area, 0) > 300""",
    "id_filter": "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 4)",
    "thumb_sizes": _GRIDS + "SELECT sid, CASE WHEN w > h THEN 1000 ELSE CAST(trunc(1000::DOUBLE * w / h) AS INTEGER) END AS w, CASE WHEN w > h THEN CAST(trunc(1000::DOUBLE * h / w) AS INTEGER) ELSE 1000 END AS h, greatest(1, CAST(trunc(ps / (greatest(w, h) / 1000.0::DOUBLE)) AS INTEGER)) AS side FROM g WHERE w > 0 AND h > 0",
    "level_ratios": _GRIDS
    + ", r AS (SELECT sid, CAST(w AS DOUBLE) / (w // 4) AS x, CAST(h AS DOUBLE) / (h // 4) AS y FROM g WHERE w > 64 AND h > 64) SELECT sid, round((x + y) / 2, 6) AS downsample, abs(x - y) > 1e-3 * abs(y) AS uneven FROM r",
    "file_mpp": """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (event_id % 7 / 8.0::DOUBLE + 0.5) / 2 ELSE event_id % 7 / 8.0::DOUBLE END AS mpp, event_id % 5 * 500.0::DOUBLE AS per_mm FROM events)
SELECT event_id, mpp, coalesce(CASE WHEN per_mm > 0 THEN 1000 / per_mm END, mpp) AS embedded, round(CASE WHEN mpp > 0 THEN 1 / (mpp * 1e-4) END, 3) AS per_cm, round((mpp / 1e6 + 5e-7) / 2 * 1e6, 6) AS scaling FROM e""",
    "legacy_coords": """WITH p AS (SELECT DISTINCT ON (patch_id) patch_id, patch_size_level0 // 4 AS ps, patch_id % 3 AS level, CASE WHEN patch_id % 2 = 0 THEN 1 ELSE 1.5 END::DOUBLE AS custom FROM patch_coords WHERE patch_id IS NOT NULL)
SELECT patch_id, pow(4.0::DOUBLE, level) * custom AS ratio, CAST(round_even(ps * pow(4.0::DOUBLE, level) * custom, 0) AS BIGINT) AS patch_size_level0 FROM p""",
    "udtf_grid": _grid_sql() + "SELECT sid, x, y FROM g",
}

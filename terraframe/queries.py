"""Queries over the core operators, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraframe.functions import scalars as S
from terraframe.functions.geometry import NUMBER, with_extent
from terraframe.operators import archive, proximity
from terraframe.operators import boxes as B
from terraframe.operators import grid as G
from terraframe.operators import metrics as M
from terraframe.operators import patches as P
from terraframe.operators import polygon as Y
from terraframe.operators import raster as R
from terraframe.operators.polygon import polygon_semi_join as polygon_semi
from terraframe.operators.spatial import rect_join, rect_semi_join
from terraframe.plans import held, pipeline, runs, shared_dir, stage
from terraframe.sources import geotiff as T
from terraframe.sources import mosaics as M_
from terraframe.sources import texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- points near others, and in regions

RADIUS_M = 25.0


def segment_points(spark: SparkSession, d: str) -> DataFrame:
    """seg_id with the centre of its extent; only dfm 1, 2 or null, and geometries that are not empty."""
    s = table(spark, d, "segments_gdf").filter("dfm is null or dfm in (1, 2)").select("seg_id", "geometry")
    return with_extent(s).filter("minx is not null").select(
        "seg_id", F.expr("(minx + maxx) / 2").alias("x"), F.expr("(miny + maxy) / 2").alias("y"))


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, raster_id and bounds, taken from the geometry where a bound is null; each cell once."""
    g = table(spark, d, "grid").select("cell_id", "raster_id", "geometry", *[F.col(c).alias(f"g_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    g = with_extent(g)
    return g.select("cell_id", "raster_id", *[F.coalesce(f"g_{c}", c).alias(c) for c in ("minx", "miny", "maxx", "maxy")]).distinct()


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments near each other, and grid cells that hold a segment."""
    pts = stage(segment_points(spark, d), "points")  # texts are parsed once
    near = proximity.near_pairs(pts, "seg_id", "x", "y", RADIUS_M)
    held = proximity.points_in_regions(pts, "seg_id", "x", "y", grid_cells(spark, d), "cell_id")
    return near.select(F.lit("near").alias("relation"), "id_a", "id_b").unionByName(
        held.select(F.lit("inside").alias("relation"), F.col("seg_id").alias("id_a"), F.col("cell_id").alias("id_b")))


# ---- masses of tiny files


def prediction_archive(spark: SparkSession, d: str) -> DataFrame:
    """The prediction files packed into containers in the shared folder, as read back."""
    files = table(spark, d, "prediction_file").select("file_id", "file_path", "content")
    return archive.write_archive(files, held(f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"), path="file_path")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that stand for each distinct record, read out of the archive."""
    return archive.distinct_boxes(archive.box_lines(archive.unpack(prediction_archive(spark, d)))).select("file_id", "line_no")


@query
def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated records with their values and number of copies."""
    return archive.distinct_boxes(archive.box_lines(archive.unpack(prediction_archive(spark, d))))


@query
def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Index of the archive: length and checksum of each file under its id and path."""
    return archive.archive_index(prediction_archive(spark, d)).select("file_id", F.col("path").alias("file_path"), F.col("length").alias("stored_bytes"))


@query
def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """How many containers the files make, how many files and bytes they hold, and whether all checksums hold."""
    blocks = prediction_archive(spark, d)
    made = blocks.agg(F.count(F.lit(1)).alias("blocks"))
    held = archive.unpack(blocks).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("bytes"), F.min("intact").alias("intact"))
    return held.withColumn("blocks", F.lit(made.first()[0]))


SQL["p3_files"] = "select file_id, file_path, cast(octet_length(encode(content)) as bigint) as stored_bytes from prediction_file"


# ---- reference operators

TILE_PX, WIDTH_PX, RADIUS_PX = 64, 64, 10
MASK_LEVEL = 1500
BOUNDS = ("minx", "miny", "maxx", "maxy")


def sql(name: str, text: str) -> None:
    SQL[name] = text


def q(c, scale: int = 10_000):
    """Quantised to whole numbers, so that both engines give the same text."""
    return F.floor(c * scale + F.lit(0.5)).cast("long")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Elevation raster of 64 columns: r, c, z in ten-thousandths; each embedding is a row of pixels."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "x"))
    return e.select("r", F.col("c").cast("long").alias("c"), q(F.col("x").cast("double")).alias("z"))


def holed(spark: SparkSession, d: str) -> DataFrame:
    """The same with nodata holes."""
    return pixels(spark, d).withColumn("z", F.when(F.expr("(r * 7 + c * 13) % 11 <> 0"), F.col("z")))


PIX = """pixels as (select vec_id as r, cast(i - 1 as bigint) as c, cast(floor(cast(embedding[i] as double) * 10000 + 0.5e0) as bigint) as z
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"""
HOLED = PIX + """, holed as (select r, c, case when (r * 7 + c * 13) % 11 <> 0 then z end as z from pixels)"""
_N = NUMBER.replace("'", "''")
_PAIR_SQL = rf"({_N})\s+({_N})(?:\s+{_N})*"


def ext_sql(g: str = "geometry") -> str:
    """Extent of a WKT column in SQL."""
    part = lambda f, k: f"list_{f}(list_transform(regexp_extract_all({g}, '{_PAIR_SQL}', {k}), lambda v: cast(v as double)))"
    return f"{part('min', 1)} as minx, {part('min', 2)} as miny, {part('max', 1)} as maxx, {part('max', 2)} as maxy"


GRID_SQL = f"""cells as (select distinct cell_id, raster_id, coalesce(g.minx, e.minx) as minx, coalesce(g.miny, e.miny) as miny, coalesce(g.maxx, e.maxx) as maxx, coalesce(g.maxy, e.maxy) as maxy
  from grid g, lateral (select {ext_sql('g.geometry')}) e)"""
SEGS_SQL = f"""segs as (select distinct seg_id, lower(trim(arch_type)) as arch_type, dfm, minx, miny, maxx, maxy from (select seg_id, arch_type, dfm, {ext_sql()} from segments_gdf) where minx is not null)"""
TILES_SQL = f"""tiles as (select distinct patch_id, filestem, res, minx, miny, maxx, maxy from (select patch_id, filestem, res, {ext_sql()} from one_tile) where minx is not null)"""
DETS_SQL = f"""dets as (select distinct det_id, lower(trim(label)) as label, score, area, prediction_path, raster_id, minx, miny, maxx, maxy from (select det_id, label, score, area, prediction_path, raster_id, {ext_sql()} from object_detection) where minx is not null)"""


def segs(spark: SparkSession, d: str) -> DataFrame:
    """seg_id, class, quality, rings and bounds of each segment once."""
    s = with_extent(table(spark, d, "segments_gdf").select("seg_id", "arch_type", "dfm", "geometry")).filter("minx is not null")
    s = s.select("seg_id", F.lower(F.trim("arch_type")).alias("arch_type"), "dfm", Y.wkt_rings(F.col("geometry")).alias("rings"), *BOUNDS)
    return s.dropDuplicates(["seg_id", "arch_type", "dfm", *BOUNDS])


def tiles(spark: SparkSession, d: str) -> DataFrame:
    t = with_extent(table(spark, d, "one_tile").select("patch_id", "filestem", "res", "geometry")).filter("minx is not null")
    return t.select("patch_id", "filestem", "res", *BOUNDS).distinct()


def dets(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """det_id, bounds and the wanted columns of each detection once; only those are read."""
    t = with_extent(table(spark, d, "object_detection").select("det_id", "geometry", *columns)).filter("minx is not null")
    return t.select("det_id", *[F.lower(F.trim(c)).alias(c) if c == "label" else F.col(c) for c in columns], *BOUNDS).distinct()


sql("p1_found", f"""with {GRID_SQL}, pts as (select distinct seg_id, (minx + maxx) / 2 as x, (miny + maxy) / 2 as y from (select seg_id, {ext_sql()} from segments_gdf where dfm is null or dfm in (1, 2)) where minx is not null)
select 'near' as relation, a.seg_id as id_a, b.seg_id as id_b from pts a join pts b on a.seg_id < b.seg_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625
union all select distinct 'inside', p.seg_id, c.cell_id from pts p join cells c on p.x >= c.minx and p.x <= c.maxx and p.y >= c.miny and p.y <= c.maxy""")

# ---- grids


@query
def bounding_grid(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 512 px over every raster."""
    return G.bounding_grid(table(spark, d, "raster"), 512)


@query
def bounding_grid_tag(spark: SparkSession, d: str) -> DataFrame:
    """Target-aligned tiles of 512 px over every raster."""
    return G.bounding_grid(table(spark, d, "raster"), 512, tag=True)


@query
def staggered_grid(spark: SparkSession, d: str) -> DataFrame:
    """Target-aligned patches of 512 px, each with a copy moved by 256 px."""
    return G.staggered_grid(table(spark, d, "raster"), 512, 256)


def _grid_sql(tag: bool) -> str:
    left, top = ("floor(x_min / t) * t", "ceil(y_max / t) * t") if tag else ("x_min", "y_max")
    return f"""r as (select *, res * 512 as t from raster), s as (select *, {left} as lf, {top} as tp from r),
 n as (select *, cast(ceil((x_min + width * res - lf) / t) as bigint) as nx, cast(ceil((tp - (y_max - height * res)) / t) as bigint) as ny from s),
 g as (select raster_id, res, ix * ny + iy as tile_id, lf + ix * t as minx, tp - iy * t - t as miny, lf + ix * t + t as maxx, tp - iy * t as maxy
  from (select *, unnest(range(0, ny)) as iy from (select *, unnest(range(0, nx)) as ix from n)))"""


sql("bounding_grid", f"with {_grid_sql(False)} select raster_id, tile_id, minx, miny, maxx, maxy from g")
sql("bounding_grid_tag", f"with {_grid_sql(True)} select raster_id, tile_id, minx, miny, maxx, maxy from g")
sql("staggered_grid", f"""with {_grid_sql(True)} select raster_id, tile_id, k as copy, minx + k * res * 256 as minx, miny + k * res * 256 as miny, maxx + k * res * 256 as maxx, maxy + k * res * 256 as maxy
 from g, (select unnest([0, 1]) as k)""")


@query
def grid_extents_struct(spark: SparkSession, d: str) -> DataFrame:
    """The same tiles with one extent each, as text."""
    e = G.extents(G.bounding_grid(table(spark, d, "raster"), 512))
    return e.select("raster_id", "tile_id", F.format_string("%.2f %.2f %.2f %.2f", "extent.left", "extent.bottom", "extent.right", "extent.top").alias("extent"))


sql("grid_extents_struct", f"with {_grid_sql(False)} select raster_id, tile_id, printf('%.2f %.2f %.2f %.2f', minx, miny, maxx, maxy) as extent from g")


@query
def tile_footprints(spark: SparkSession, d: str) -> DataFrame:
    """One box per stored raster tile."""
    return G.footprints(table(spark, d, "raster").withColumnRenamed("raster_id", "tile_id"))


sql("tile_footprints", "select raster_id as tile_id, x_min as minx, y_max - height * res as miny, x_min + width * res as maxx, y_max as maxy from raster")


# ---- pixels and tiles


@query
def valid_mask_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Per tile of 16 px the number of pixels and of valid pixels; tiles without any are skipped."""
    g = G.in_windows(holed(spark, d), 16).groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n_pix"), F.count("z").alias("n_valid"))
    return g.filter("n_valid > 0")


sql("valid_mask_tiles", f"with {HOLED} select r // 16 as tr, c // 16 as tc, count(*) as n_pix, count(z) as n_valid from holed group by all having count(z) > 0")


LOWEST = -3.4028234663852886e38  # of a 32-bit float, a common nodata value


@query
def nodata_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pixels and valid pixels of every raster under its own nodata value (null, NaN or a number); rows of pixels go round all rasters."""
    nod = table(spark, d, "raster").select("raster_id", "nodata", (F.row_number().over(W.orderBy("raster_id")) - 1).cast("long").alias("k"))
    z = F.when(F.expr("(r * 7 + c * 13) % 11 = 0"), F.lit(0.0)).when(F.expr("(r + c) % 7 = 0"), F.lit(-9999.0)).when(F.expr("(r + 2 * c) % 5 = 0"), F.lit(LOWEST)).otherwise(F.col("z").cast("double"))
    n = table(spark, d, "raster").count()
    p = pixels(spark, d).select((F.col("r") % F.lit(max(n, 1))).alias("k"), z.alias("z"))
    valid = R.valid_pixels(p.join(nod, "k"), "nodata").groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_valid"))
    whole = p.groupBy("k").agg(F.count(F.lit(1)).alias("n_pix")).join(nod, "k").select("raster_id", "n_pix")
    return whole.join(valid, "raster_id", "left").select("raster_id", "n_pix", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


sql("nodata_kinds", f"""with {PIX}, k as (select raster_id, nodata, row_number() over (order by raster_id) - 1 as k from raster), p as (select r % (select count(*) from raster) as k, case when (r * 7 + c * 13) % 11 = 0 then 0 when (r + c) % 7 = 0 then -9999 when (r + 2 * c) % 5 = 0 then {LOWEST!r} else z end as z from pixels)
select raster_id, count(*) as n_pix, count(*) filter (nodata is null or isnan(nodata) or z <> nodata) as n_valid from p join k using (k) group by raster_id""")


@query
def outline_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 8 px that meet ground above the mask level, touching included."""
    return G.outline_tiles(pixels(spark, d).filter(F.col("z") >= MASK_LEVEL), 8).filter("tr >= 0 and tc >= 0 and tc < 8")


sql("outline_filter", f"""with {PIX}, v as (select r, c from pixels where z >= {MASK_LEVEL}), t as (select tr, tc from (select unnest(range(0, (select max(r) // 8 + 2 from pixels))) as tr), (select unnest(range(0, 8)) as tc))
select distinct tr, tc from t join v on v.r <= tr * 8 + 8 and v.r + 1 >= tr * 8 and v.c <= tc * 8 + 8 and v.c + 1 >= tc * 8""")


@query
def tile_window_halo(spark: SparkSession, d: str) -> DataFrame:
    """Pixels, valid pixels and sum of each tile of 32 px read with a halo of 4."""
    w = G.in_windows(holed(spark, d), 32, 4).filter("tc < 2")
    return w.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n_pix"), F.count("z").alias("n_valid"), F.sum("z").alias("sum_z"))


sql("tile_window_halo", f"""with {HOLED}, t as (select tr, tc from (select unnest(range(0, (select (max(r) + 4) // 32 + 1 from pixels))) as tr), (select unnest(range(0, 2)) as tc))
select tr, tc, count(*) as n_pix, count(z) as n_valid, cast(sum(z) as bigint) as sum_z from t join holed on r between tr * 32 - 4 and tr * 32 + 35 and c between tc * 32 - 4 and tc * 32 + 35 group by tr, tc""")


@query
def clip_tile_values(spark: SparkSession, d: str) -> DataFrame:
    """Pixel values of the clipped tiles: nodata to 0, held to [0, 1]."""
    v = S.unit_clamped(F.col("z") / 1000)
    return holed(spark, d).select("r", "c", F.floor(v * 1000 + F.lit(0.5)).cast("long").alias("v"))


sql("clip_tile_values", f"with {HOLED} select r, c, cast(floor(least(1.0e0, greatest(0.0e0, coalesce(z / 1000.0e0, 0.0e0))) * 1000 + 0.5e0) as bigint) as v from holed")


def relief(spark: SparkSession, d: str) -> DataFrame:
    """Local relief of the holed raster, stretched to [0, 1]."""
    return R.visualised(holed(spark, d), RADIUS_PX, 10_000.0)


@query
def slrm(spark: SparkSession, d: str) -> DataFrame:
    """The local relief model, in millionths."""
    return relief(spark, d).select("r", "c", q(F.col("v"), 1_000_000).alias("v"))


@query
def slrm_tiled(spark: SparkSession, d: str) -> DataFrame:
    """The same by tiles with a halo: the form for large rasters."""
    t = R.local_relief_tiled(holed(spark, d), RADIUS_PX, TILE_PX)
    return t.select("r", "c", q(S.stretched(F.col("relief") / 10_000.0), 1_000_000).alias("v"))


SLRM_SQL = HOLED + """, s1 as (select *, sum(z) over (partition by r order by c range between 10 preceding and 10 following) as s1, count(z) over (partition by r order by c range between 10 preceding and 10 following) as n1 from holed),
 s2 as (select *, sum(s1) over (partition by c order by r range between 10 preceding and 10 following) as s, sum(n1) over (partition by c order by r range between 10 preceding and 10 following) as n from s1),
 vis as (select r, c, z, coalesce(least(1.0e0, greatest(0.0e0, ((z - cast(s as double) / cast(n as double)) / 10000.0e0 + 0.5e0) / 1.0e0)), 0.0e0) as v from s2)"""
sql("slrm", f"with {SLRM_SQL} select r, c, cast(floor(v * 1000000 + 0.5e0) as bigint) as v from vis")
sql("slrm_tiled", SQL["slrm"])


@query
def slrm_stats_by_tile(spark: SparkSession, d: str) -> DataFrame:
    """Per tile the number, sum, least and greatest relief value in millionths."""
    v = slrm(spark, d).withColumn("tr", F.floor(F.col("r") / TILE_PX))
    return v.groupBy("tr").agg(F.count("v").alias("n"), F.sum("v").alias("sum_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


sql("slrm_stats_by_tile", f"with {SLRM_SQL}, q as (select r // 64 as tr, cast(floor(v * 1000000 + 0.5e0) as bigint) as v from vis) select tr, count(v) as n, cast(sum(v) as bigint) as sum_v, min(v) as min_v, max(v) as max_v from q group by tr")


@query
def relief_radius(spark: SparkSession, d: str) -> DataFrame:
    """Radius in pixels for each raster's resolution, and the largest halo."""
    return table(spark, d, "raster").groupBy("res").agg(F.max(S.relief_radius(F.col("res"))).alias("radius"), F.count(F.lit(1)).alias("rasters"))


sql("relief_radius", "select res, max(case when res < 1 then cast(ceil(10.0e0 / res) as int) else 10 end) as radius, count(*) as rasters from raster group by res")


@query
def mosaic_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Mosaic of overlapping tiles (32 px with a halo of 4): the last tile shows."""
    w = G.in_windows(holed(spark, d), 32, 4).filter("tc < 2").withColumn("seq", F.col("tr") * 2 + F.col("tc"))
    return R.mosaic(w.withColumn("z", F.col("z") + F.col("seq")), "seq").select("r", "c", "z")


sql("mosaic_last_wins", f"""with {HOLED}, t as (select tr, tc from (select unnest(range(0, (select (max(r) + 4) // 32 + 1 from pixels))) as tr), (select unnest(range(0, 2)) as tc)),
 w as (select r, c, tr * 2 + tc as seq, z + tr * 2 + tc as z from t join holed on r between tr * 32 - 4 and tr * 32 + 35 and c between tc * 32 - 4 and tc * 32 + 35)
select r, c, arg_max(z, seq) as z from w where z is not null group by r, c""")


@query
def threshold_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels whose probability (here the relief) is at least 0.5."""
    p = relief(spark, d).withColumn("p", q(F.col("v"), 1_000_000) / F.lit(1e6))
    return R.thresholded(p, "p").select("r", "c")


@query
def threshold_mask_nan(spark: SparkSession, d: str) -> DataFrame:
    """The same where nodata pixels have the probability NaN: they are dropped."""
    p = relief(spark, d).withColumn("p", F.when(F.col("z").isNull(), F.lit(float("nan"))).otherwise(q(F.col("v"), 1_000_000) / F.lit(1e6)))
    return R.thresholded(p, "p").groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("sum_c"))


sql("threshold_mask", f"with {SLRM_SQL} select r, c from vis where cast(floor(v * 1000000 + 0.5e0) as bigint) / 1000000.0e0 >= 0.5e0")
sql("threshold_mask_nan", f"with {SLRM_SQL} select r, count(*) as n, cast(sum(c) as bigint) as sum_c from vis where z is not null and cast(floor(v * 1000000 + 0.5e0) as bigint) / 1000000.0e0 >= 0.5e0 group by r")


def mask_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.components(pixels(spark, d).filter(F.col("z") >= MASK_LEVEL), TILE_PX, WIDTH_PX)


COMP_SQL = PIX + f""", m as (select r, c, r // 64 as tr, r * 64 + c as id from pixels where z >= {MASK_LEVEL}),
 e as (select a.id as a, b.id as b from m a join m b on a.tr = b.tr and ((b.r = a.r and b.c in (a.c - 1, a.c + 1)) or (b.c = a.c and b.r in (a.r - 1, a.r + 1)))),
 reach(id, other) as (select id, id from m union select reach.id, e.b from reach join e on reach.other = e.a),
 comp as (select id, min(other) as part from reach group by id),
 parts as (select m.tr, m.r, m.c, comp.part from m join comp using (id))"""


@query
def mask_components(spark: SparkSession, d: str) -> DataFrame:
    """4-connected parts of the mask within each tile."""
    return mask_parts(spark, d).select("tr", "r", "c", "part")


sql("mask_components", f"with recursive {COMP_SQL} select tr, r, c, part from parts")


@query
def mask_features_min_area(spark: SparkSession, d: str) -> DataFrame:
    """Features of the mask larger than 0.3 square metres at half a metre a pixel."""
    f = R.features(mask_parts(spark, d), 0.5)
    return B.at_least(f, "area", 0.3).select("tr", "part", "n_pix", "area", "c0", "r0", "c1", "r1")


sql("mask_features_min_area", f"with recursive {COMP_SQL} select tr, part, count(*) as n_pix, count(*) * 0.25e0 as area, min(c) as c0, min(r) as r0, max(c) + 1 as c1, max(r) + 1 as r1 from parts group by tr, part having count(*) * 0.25e0 > 0.3e0")


@query
def mask_features_roundness(spark: SparkSession, d: str) -> DataFrame:
    """Features rounder than 0.5, their roundness in ten-thousandths, then larger than the least area."""
    f = R.features(mask_parts(spark, d), 0.5, with_hull=True).withColumn("roundness", S.roundness(F.col("area"), F.col("hull")))
    return B.at_least(B.at_least(f, "roundness", 0.5), "area", 0.3).select("tr", "part", "area", q(F.col("roundness")).alias("roundness"))


@query
def mask_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of the mask features as polygon texts."""
    return R.polygons(mask_parts(spark, d), 600000.0, 700000.0, 0.5).select("part", "geometry")


# ---- boxes


def box_records(spark: SparkSession, d: str) -> DataFrame:
    """Box records of all prediction files, with a number within the file."""
    r = archive.box_lines(table(spark, d, "prediction_file").select("file_id", "content"))
    return r.withColumn("box_no", F.col("line_no"))


_LINE = rf"^{NUMBER}([ \t]+{NUMBER}){{3}}[ \t]+[^ \t]+([ \t]+{NUMBER}){{5}}$"
LINES_SQL = rf"""lines as (select file_id, n as line_no, regexp_replace(regexp_replace(ls[n], '^[ \t]+', ''), '[ \t\r]+$', '') as line from (select file_id, ls, unnest(range(1, len(ls) + 1)) as n
  from (select file_id, regexp_split_to_array(regexp_replace(content, '^' || chr(65279), ''), '\r?\n') as ls from prediction_file))),
 f as (select file_id, line_no, regexp_split_to_array(line, '[ \t]+') as f from lines where regexp_matches(line, '{_LINE}')),
 recs as (select file_id, line_no, cast(f[1] as double) as x0, cast(f[2] as double) as y0, cast(f[3] as double) as x1, cast(f[4] as double) as y1, f[5] as label, cast(f[6] as double) as score, cast(f[7] as double) as epsg, cast(f[8] as double) as res, cast(f[9] as double) as x_min, cast(f[10] as double) as y_max from f),
 world as (select *, x_min + res * x0 as minx, y_max - res * y1 as miny, x_min + res * x1 as maxx, y_max - res * y0 as maxy from recs)"""


@query
def boxes_parse_text(spark: SparkSession, d: str) -> DataFrame:
    """Every readable box line of every prediction file."""
    return box_records(spark, d).drop("box_no")


sql("boxes_parse_text", f"with {LINES_SQL} select file_id, line_no, x0, y0, x1, y1, label, score, epsg, res, x_min, y_max from recs")
sql("p3_found", f"""with {LINES_SQL} select file_id, line_no from (select *, row_number() over (partition by lower(label), x0, y0, x1, y1, score, epsg, res, x_min, y_max order by file_id, line_no) as k from recs) where k = 1""")
sql("p3_records", f"""with {LINES_SQL} select file_id, line_no, x0, y0, x1, y1, label, score, epsg, res, x_min, y_max, copies from (select *, row_number() over w as k, count(*) over (partition by lower(label), x0, y0, x1, y1, score, epsg, res, x_min, y_max) as copies from recs window w as (partition by lower(label), x0, y0, x1, y1, score, epsg, res, x_min, y_max order by file_id, line_no)) where k = 1""")


@query
def boxes_render_text(spark: SparkSession, d: str) -> DataFrame:
    """Boxes at half the resolution as lines of a box file, with rounding to even."""
    r = box_records(spark, d).withColumns({c: F.col(c) / 2 for c in ("x0", "y0", "x1", "y1")})
    r = r.withColumns({"epsg": F.col("epsg"), "res": q(F.col("res"), 100), "x_min": q(F.col("x_min"), 100), "y_max": q(F.col("y_max"), 100)})
    return B.box_text(r).select("file_id", "line_no", "line")


sql("boxes_render_text", f"""with {LINES_SQL} select file_id, line_no, concat_ws(' ', cast(round_even(x0 / 2, 0) as bigint), cast(round_even(y0 / 2, 0) as bigint), cast(round_even(x1 / 2, 0) as bigint), cast(round_even(y1 / 2, 0) as bigint), label, printf('%.4f', score),
 cast(epsg as bigint), cast(floor(res * 100 + 0.5e0) as bigint), cast(floor(x_min * 100 + 0.5e0) as bigint), cast(floor(y_max * 100 + 0.5e0) as bigint)) as line from recs""")


@query
def boxes_to_world(spark: SparkSession, d: str) -> DataFrame:
    """Ground bounds of every box, in centimetres."""
    return B.world_boxes(box_records(spark, d)).select("file_id", "line_no", "label", *[q(F.col(c), 100).alias(c) for c in BOUNDS])


sql("boxes_to_world", f"with {LINES_SQL} select file_id, line_no, label, " + ", ".join(f"cast(floor({c} * 100 + 0.5e0) as bigint) as {c}" for c in BOUNDS) + " from world")


@query
def score_filter(spark: SparkSession, d: str) -> DataFrame:
    """Detections whose written score is above 0.5, per label."""
    return B.confident(dets(spark, d, "label", "score")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("det_id").alias("sum_id"))


sql("score_filter", f"with {DETS_SQL} select label, count(*) as n, cast(sum(det_id) as bigint) as sum_id from dets where score is not null and not isnan(score) and cast(printf('%.4f', score) as double) > 0.5e0 group by label")


def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    r = B.world_boxes(B.confident(box_records(spark, d)))
    return B.parts(r, "file_id")


PARTS_SQL = LINES_SQL + """, b as (select * from world where score > 0.5e0 and maxx > minx and maxy > miny),
 pair as (select a.file_id, a.line_no as a, c.line_no as b, c.score as score, least(a.maxx, c.maxx) - greatest(a.minx, c.minx) as w, least(a.maxy, c.maxy) - greatest(a.miny, c.miny) as h from b a join b c on a.file_id = c.file_id and a.minx <= c.maxx and c.minx <= a.maxx and a.miny <= c.maxy and c.miny <= a.maxy),
 reach(file_id, a, b) as (select file_id, line_no, line_no from b union select reach.file_id, reach.a, pair.b from reach join pair on reach.file_id = pair.file_id and reach.b = pair.a where pair.w + pair.h > 0),
 comp as (select file_id, a as box_no, min(b) as part from reach group by file_id, a),
 merged as (select comp.file_id, comp.box_no, comp.part, b.minx, b.miny, b.maxx, b.maxy, (select max(score) from pair where pair.file_id = comp.file_id and pair.a = comp.box_no) as reach from comp join b on b.file_id = comp.file_id and b.line_no = comp.box_no)"""


@query
def box_parts(spark: SparkSession, d: str) -> DataFrame:
    """The part each confident box of a file belongs to."""
    return merged_boxes(spark, d).select("file_id", "box_no", "part")


def box_features(spark: SparkSession, d: str, geometry: bool = False) -> DataFrame:
    return B.part_features(B.world_boxes(B.confident(box_records(spark, d))), "file_id", geometry=geometry)


@query
def box_parts_score(spark: SparkSession, d: str) -> DataFrame:
    """Best score of each part, boxes that touch only a corner included."""
    return box_features(spark, d).select("file_id", "part", "n_boxes", "score")


sql("box_parts", f"with recursive {PARTS_SQL} select file_id, box_no, part from merged")
sql("box_parts_score", f"with recursive {PARTS_SQL} select file_id, part, count(*) as n_boxes, max(reach) as score from merged group by file_id, part")


@query
def box_union_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each part, overlap counted once, in hundredths."""
    return box_features(spark, d).select("file_id", "part", q(F.col("area"), 100).alias("area"))


@query
def box_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The same area measured on the parts' outlines."""
    shapes = box_features(spark, d, geometry=True).select("file_id", "part", Y.wkt_rings(F.col("geometry")).alias("rings"))
    return Y.with_measures(shapes, "rings").select("file_id", "part", q(F.col("area"), 100).alias("area"))


@query
def box_features_min_area(spark: SparkSession, d: str) -> DataFrame:
    """Object detection features: parts larger than 400 square metres with their score."""
    f = box_features(spark, d).withColumn("area", q(F.col("area"), 100))
    return B.at_least(f, "area", 40_000).select("file_id", "part", "score", "area")


AREA_SQL = PARTS_SQL + """, xs as (select distinct file_id, part, unnest([minx, maxx]) as x from merged), strips as (select *, lead(x) over (partition by file_id, part order by x) as x2 from xs),
 ins as (select s.file_id, s.part, s.x, s.x2, m.miny, m.maxy from strips s join merged m on s.file_id = m.file_id and s.part = m.part and m.minx <= s.x and m.maxx >= s.x2 where s.x2 is not null),
 run as (select *, max(maxy) over (partition by file_id, part, x order by miny, maxy rows between unbounded preceding and 1 preceding) as past from ins),
 areas as (select file_id, part, sum((x2 - x) * greatest(0, maxy - greatest(miny, coalesce(past, miny)))) as area from run group by file_id, part)"""
sql("box_union_area", f"with recursive {AREA_SQL} select file_id, part, cast(floor(area * 100 + 0.5e0) as bigint) as area from areas")
sql("box_outlines", SQL["box_union_area"])
sql("box_features_min_area", f"with recursive {AREA_SQL}, sc as (select file_id, part, max(reach) as score from merged group by file_id, part) select file_id, part, score, cast(floor(area * 100 + 0.5e0) as bigint) as area from sc join areas using (file_id, part) where cast(floor(area * 100 + 0.5e0) as bigint) > 40000")


@query
def provenance_path(spark: SparkSession, d: str) -> DataFrame:
    """The last three parts of each detection's prediction path, under its run's folder."""
    t = table(spark, d, "object_detection").filter("prediction_path is not null").select("det_id", F.concat(F.lit("/data/"), F.col("run_code"), F.lit("/"), F.col("prediction_path")).alias("p")).distinct()
    return t.select("det_id", S.path_tail(F.col("p")).alias("prediction_path"))


sql("provenance_path", "select det_id, array_to_string(list_slice(string_split(p, '/'), -3, -1), '/') as prediction_path from (select distinct det_id, '/data/' || run_code || '/' || prediction_path as p from object_detection where prediction_path is not null)")


@query
def detections_min_area(spark: SparkSession, d: str) -> DataFrame:
    """Detections larger than 40 square metres, by their own box, per raster."""
    f = dets(spark, d, "raster_id").withColumn("box_area", q((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), 100))
    return B.at_least(f, "box_area", 4000).groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("box_area").alias("area"))


sql("detections_min_area", f"with {DETS_SQL}, f as (select raster_id, cast(floor((maxx - minx) * (maxy - miny) * 100 + 0.5e0) as bigint) as a from dets) select raster_id, count(*) as n, cast(sum(a) as bigint) as area from f where a > 4000 group by raster_id")

# ---- spatial joins and patches

CELL_M = 256.0


@query
def spatial_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells that a segment meets, touching included."""
    return rect_semi_join(grid_cells(spark, d), segs(spark, d), ["cell_id"], CELL_M).select("cell_id", "raster_id")


@query
def spatial_inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Patches with the segments that meet them."""
    return rect_join(tiles(spark, d), segs(spark, d), CELL_M).select("patch_id", F.col("r_seg_id").alias("seg_id"))


sql("spatial_semi_join", f"with {GRID_SQL}, {SEGS_SQL} select cell_id, raster_id from cells c where exists (select 1 from segs s where s.minx <= c.maxx and s.maxx >= c.minx and s.miny <= c.maxy and s.maxy >= c.miny)")
sql("spatial_inner_join", f"with {TILES_SQL}, {SEGS_SQL} select patch_id, seg_id from tiles c join segs s on s.minx <= c.maxx and s.maxx >= c.minx and s.miny <= c.maxy and s.maxy >= c.miny")


@query
def polygon_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells that a segment's own outline meets, touching included; points count by their place."""
    return polygon_semi(grid_cells(spark, d), segs(spark, d), ["cell_id"], CELL_M).select("cell_id", "raster_id")


def shown(spark: SparkSession, d: str) -> DataFrame:
    return P.shown_segments(tiles(spark, d), segs(spark, d), CELL_M)


_RING = r"regexp_extract_all(regexp_replace(geometry, '\s*\(\s*', '(', 'g'), '\(+[^()]*\)')"
# edges of all polygons; area under an edge held to a box of w * h at the origin
EDGES_SQL = rf"""polys as (select seg_id, any_value(geometry) as geometry, any_value(lower(trim(arch_type))) as arch_type, any_value(dfm) as dfm from segments_gdf where geometry is not null group by seg_id),
 ring as (select seg_id, k, starts_with(t, '((') as filled, list_transform(regexp_extract_all(t, '{_PAIR_SQL}', 1), lambda v: cast(v as double)) as xs, list_transform(regexp_extract_all(t, '{_PAIR_SQL}', 2), lambda v: cast(v as double)) as ys from (select seg_id, k, rs[k] as t from (select seg_id, rs, unnest(range(1, len(rs) + 1)) as k from (select seg_id, {_RING} as rs from polys)))),
 edge as (select seg_id, k, filled, xs[i] as x1, ys[i] as y1, xs[i % len(xs) + 1] as x2, ys[i % len(ys) + 1] as y2 from (select *, unnest(range(1, len(xs) + 1)) as i from ring where len(xs) >= 3)),
 ext as (select seg_id, min(x1) as sx0, min(y1) as sy0, max(x1) as sx1, max(y1) as sy1 from edge group by seg_id),
 whole as (select seg_id, sum(case when filled then a else -a end) as whole from (select seg_id, k, any_value(filled) as filled, abs(sum(((x1 - sx0) * (y2 - sy0) - (x2 - sx0) * (y1 - sy0)) / 2)) as a from edge join ext using (seg_id) group by seg_id, k) group by seg_id)"""
_CLIP_SQL = """met as (select t.patch_id, t.filestem, t.res, t.minx, t.miny, t.maxx, t.maxy, s.*, whole, sx0 >= t.minx and sy0 >= t.miny and sx1 <= t.maxx and sy1 <= t.maxy as inside from tiles t join ext s on s.sx0 <= t.maxx and s.sx1 >= t.minx and s.sy0 <= t.maxy and s.sy1 >= t.miny join whole using (seg_id)),
 cutat as (select patch_id, seg_id, minx, miny, maxx, maxy, k, filled, maxx - minx as w, maxy - miny as h, x1 - minx as x1, y1 - miny as y1, x2 - minx as x2, y2 - miny as y2 from met join edge using (seg_id) where not inside),
 held as (select *, y1 + s * (a - x1) as ya, y1 + s * (b - x1) as yb from (select *, greatest(0, least(w, x1)) as a, greatest(0, least(w, x2)) as b, case when x1 = x2 then 0 else (y2 - y1) / (x2 - x1) end as s from cutat)),
 under as (select patch_id, seg_id, k, filled, (b - a) * case when least(ya, yb) >= 0 and greatest(ya, yb) <= h or abs(yb - ya) < 1e-9 then greatest(0, least(h, (ya + yb) / 2))
  else ((case when yb > h then h * h / 2 + h * (yb - h) else greatest(yb, 0) * greatest(yb, 0) / 2 end) - (case when ya > h then h * h / 2 + h * (ya - h) else greatest(ya, 0) * greatest(ya, 0) / 2 end)) / (yb - ya) end as a from held),
 part as (select patch_id, seg_id, sum(case when filled then a else -a end) as part from (select patch_id, seg_id, k, any_value(filled) as filled, abs(sum(a)) as a from under group by patch_id, seg_id, k) group by patch_id, seg_id),
 -- bounds of what lies in the patch: edges cut by its sides, and its corners inside the polygon
 ts as (select patch_id, seg_id, x1, y1, x2, y2, w, h, minx, miny, greatest(0, case when x1 = x2 then case when x1 >= 0 and x1 <= w then 0 else 2 end else least((0 - x1) / (x2 - x1), (w - x1) / (x2 - x1)) end, case when y1 = y2 then case when y1 >= 0 and y1 <= h then 0 else 2 end else least((0 - y1) / (y2 - y1), (h - y1) / (y2 - y1)) end) as t0,
  least(1, case when x1 = x2 then 1 else greatest((0 - x1) / (x2 - x1), (w - x1) / (x2 - x1)) end, case when y1 = y2 then 1 else greatest((0 - y1) / (y2 - y1), (h - y1) / (y2 - y1)) end) as t1 from cutat),
 ends as (select patch_id, seg_id, minx + greatest(0, least(w, case when t = 1 then x2 else x1 + (x2 - x1) * t end)) as x, miny + greatest(0, least(h, case when t = 1 then y2 else y1 + (y2 - y1) * t end)) as y from (select *, unnest([t0, t1]) as t from ts where t0 <= t1)),
 corner as (select patch_id, seg_id, cx + minx as x, cy + miny as y from (select patch_id, seg_id, minx, miny, x1, y1, x2, y2, unnest([0, 0, w, w]) as cx, unnest([0, h, 0, h]) as cy from cutat) group by patch_id, seg_id, minx, miny, cx, cy having sum(case when (y1 > cy) <> (y2 > cy) and cx < x1 + (cy - y1) * (x2 - x1) / (y2 - y1) then 1 else 0 end) % 2 = 1),
 bounds as (select patch_id, seg_id, min(x) as bx0, min(y) as by0, max(x) as bx1, max(y) as by1 from (select * from ends union all select * from corner) group by patch_id, seg_id),
 shown as (select * from (select met.*, arch_type, dfm, case when inside then 1 else part / whole end as fraction, case when inside then sx0 else bx0 end as ix0, case when inside then sx1 else bx1 end as ix1, case when inside then sy0 else by0 end as iy0, case when inside then sy1 else by1 end as iy1
  from met join polys using (seg_id) left join part using (patch_id, seg_id) left join bounds using (patch_id, seg_id) where whole > 0) where fraction > 0.33e0),
 px as (select *, greatest(cast(trunc((ix0 - minx) / res) as bigint), 0) as rx0, least(cast(trunc((ix1 - minx) / res) as bigint), cast(trunc((maxx - minx) / res) as bigint)) as rx1,
  greatest(cast(trunc((maxy - iy1) / res) as bigint), 0) as ry0, least(cast(trunc((maxy - iy0) / res) as bigint), cast(trunc((maxx - minx) / res) as bigint)) as ry1 from shown),
 lines as (select *, concat_ws(' ', rx0, ry0, rx1, ry0, rx1, ry1, rx0, ry1, arch_type, coalesce(dfm, 1)) as line from px)"""
SHOWN_SQL = f"{TILES_SQL}, {EDGES_SQL}, {_CLIP_SQL}"


@query
def segment_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Segments of which more than 0.33 lies in a patch, with the fraction in ten-thousandths and the edge flag."""
    return shown(spark, d).select("patch_id", F.col("r_seg_id").alias("seg_id"), q(F.col("fraction")).alias("fraction"), "edge")


@query
def relative_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Pixel bounds of the shown segments in their patches."""
    return P.relative_bounds(shown(spark, d)).select("patch_id", F.col("r_seg_id").alias("seg_id"), "rx0", "ry0", "rx1", "ry1", "corners")


@query
def labeltxt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Label line of each shown segment."""
    return P.label_lines(P.relative_bounds(shown(spark, d)), "r_arch_type", "r_dfm").select("patch_id", F.col("r_seg_id").alias("seg_id"), "line")


@query
def labeltxt_by_patch(spark: SparkSession, d: str) -> DataFrame:
    """Label text of each patch that shows a segment."""
    return P.label_texts(labeltxt_lines(spark, d), "patch_id", "seg_id")


sql("polygon_semi_join", f"""with {GRID_SQL}, {SEGS_SQL}, tiles as (select cell_id as patch_id, null as filestem, 1 as res, minx, miny, maxx, maxy from cells), {EDGES_SQL}, {_CLIP_SQL},
 hit as (select patch_id from met left join bounds using (patch_id, seg_id) where inside or bx0 is not null union select t.patch_id from tiles t join segs s on s.minx <= t.maxx and s.maxx >= t.minx and s.miny <= t.maxy and s.maxy >= t.miny where s.seg_id not in (select seg_id from edge))
select cell_id, raster_id from cells where cell_id in (select patch_id from hit)""")
sql("segment_fraction", f"with {SHOWN_SQL} select patch_id, seg_id, cast(floor(fraction * 10000 + 0.5e0) as bigint) as fraction, case when fraction < 1 then 1 else 0 end as edge from shown")
sql("relative_bounds", f"with {SHOWN_SQL} select patch_id, seg_id, rx0, ry0, rx1, ry1, concat_ws(' ', rx0, ry0, rx1, ry0, rx1, ry1, rx0, ry1) as corners from px")
sql("labeltxt_lines", f"with {SHOWN_SQL} select patch_id, seg_id, line from lines")
sql("labeltxt_by_patch", f"with {SHOWN_SQL} select patch_id, string_agg(line, chr(10) order by seg_id, line) as labeltxt from lines group by patch_id")

CLASSES = ["barrow", "enclosure", "ringfort"]


def mask_segments(spark: SparkSession, d: str) -> DataFrame:
    """Shown segments of three classes with band, place in the order and quality."""
    band = F.lit(None).cast("int")
    for c, k in P.class_bands(CLASSES).items():
        band = F.when(F.col("r_arch_type") == c, k).otherwise(band)
    return shown(spark, d).select("patch_id", "minx", "miny", "maxx", "maxy", "res", "r_rings", band.alias("band"), F.col("r_seg_id").alias("seq"), P.default_quality(F.col("r_dfm")).alias("dfm")).filter("band is not null")


@query
def mask_rasterise(spark: SparkSession, d: str) -> DataFrame:
    """The masks of all patches in the patches' own pixels: number and place sums of pixels by band and value."""
    return P.mask_sums(mask_segments(spark, d))


# the pixels that edges cross, row by row, and those whose centre is inside
sql("mask_rasterise", f"""with {SHOWN_SQL}, size as (select patch_id, seg_id, band, dfm, minx, maxy, res, cast(ceil(round((maxy - miny) / res, 6)) as bigint) as nr, cast(ceil(round((maxx - minx) / res, 6)) as bigint) as nc from (select *, case arch_type when 'barrow' then 0 when 'enclosure' then 1 when 'ringfort' then 2 end as band from shown) where band is not null and res > 0),
 e as (select patch_id, seg_id, nr, nc, case when down then px2 else px1 end as xa, case when down then py2 else py1 end as ya, case when down then px1 else px2 end as xb, case when down then py1 else py2 end as yb from (select *, py1 > py2 as down from (select patch_id, seg_id, nr, nc, (x1 - minx) / res as px1, (maxy - y1) / res as py1, (x2 - minx) / res as px2, (maxy - y2) / res as py2 from size join edge using (seg_id)))),
 g as (select *, case when yb > ya then (xb - xa) / (yb - ya) else 0 end as s from e),
 cross_ as (select patch_id, seg_id, nc, r, case when r <= ya then xa else xa + (r - ya) * s end as u, case when r + 1 >= yb then xb else xa + (r + 1 - ya) * s end as v from (select *, unnest(range(greatest(0, cast(floor(ya) as bigint)), least(nr, cast(ceil(yb) as bigint)))) as r from g)),
 mid as (select patch_id, seg_id, r, greatest(0, least(nc, cast(ceil(x - 0.5e0) as bigint))) as c from (select *, xa + (r + 0.5e0 - ya) * s as x from (select *, unnest(range(greatest(0, cast(ceil(ya - 0.5e0) as bigint)), least(nr, cast(ceil(yb - 0.5e0) as bigint)))) as r from g))),
 pair as (select patch_id, seg_id, r, c as lo, lead(c) over w as hi, row_number() over w as k from mid window w as (partition by patch_id, seg_id, r order by c)),
 runs as (select patch_id, seg_id, r, greatest(0, cast(floor(least(u, v)) as bigint)) as lo, least(nc, cast(ceil(greatest(u, v)) as bigint)) as hi from cross_ union all select patch_id, seg_id, r, lo, hi from pair where k % 2 = 1),
 cells as (select distinct patch_id, seg_id, r, unnest(range(lo, hi)) as c from runs where hi > lo),
 burned as (select patch_id, band, r, c, arg_max(dfm, seg_id) as v from cells join (select patch_id, seg_id, band, coalesce(dfm, 1) as dfm from size) using (patch_id, seg_id) group by all)
select patch_id, band, v, count(*) as n, cast(sum(r) as bigint) as sum_row, cast(sum(c) as bigint) as sum_col from burned group by patch_id, band, v""")


@query
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    """Exact area and roundness of every segment polygon, in hundredths and ten-thousandths."""
    s = Y.with_measures(segs(spark, d).select("seg_id", "rings"), "rings").filter("area is not null")
    return s.select("seg_id", q(F.col("area"), 100).alias("area"), q(S.roundness(F.col("area"), F.col("hull"))).alias("roundness"))


def hull_sql(points: str, key: str) -> str:
    """Perimeter of the convex hull of points (key, x, y): pairs with all other points on one side and none of their line beyond them."""
    return f"""sides as (select {', '.join('p.' + k.strip() for k in key.split(','))}, p.x as px, p.y as py, q.x as qx, q.y as qy from {points} p join {points} q using ({key}) where p.x <> q.x or p.y <> q.y),
 hull as (select {key}, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) as hull from (select {key}, px, py, qx, qy from sides join {points} t using ({key}) group by all having bool_and((qx - px) * (t.y - py) - (qy - py) * (t.x - px) > 0 or ((qx - px) * (t.y - py) - (qy - py) * (t.x - px) = 0 and (t.x - px) * (t.x - qx) + (t.y - py) * (t.y - qy) <= 0))) group by {key})"""


sql("polygon_measures", f"""with {EDGES_SQL}, pts as (select distinct seg_id, x1 as x, y1 as y from edge), {hull_sql('pts', 'seg_id')}
select seg_id, cast(floor(whole * 100 + 0.5e0) as bigint) as area, cast(floor(4 * pi() * whole / (hull * hull) * 10000 + 0.5e0) as bigint) as roundness from whole join hull using (seg_id)""")
sql("mask_features_roundness", f"""with recursive {COMP_SQL}, pts as (select distinct tr, part, cast(c + i as double) as x, cast(r + j as double) as y from parts, (select unnest([0, 1]) as i), (select unnest([0, 1]) as j)), {hull_sql('pts', 'tr, part')},
 n as (select tr, part, count(*) * 0.25e0 as area from parts group by tr, part)
select tr, part, area, cast(floor(4 * pi() * area / (hull * hull * 0.25e0) * 10000 + 0.5e0) as bigint) as roundness from n join hull using (tr, part) where 4 * pi() * area / (hull * hull * 0.25e0) > 0.5e0 and area > 0.3e0""")


@query
def mask_polygon_edges(spark: SparkSession, d: str) -> DataFrame:
    """The unit edges of the outlines of `mask_polygons`, in half-pixel ground units from their corner."""
    p = mask_polygons(spark, d).select("part", F.explode(Y.wkt_rings(F.col("geometry"))).alias("g"))
    p = p.select("part", F.explode(F.expr("transform(sequence(1, size(g.x) - 1), i -> struct(element_at(g.x, i) as x, element_at(g.y, i) as y, element_at(g.x, i + 1) as x2, element_at(g.y, i + 1) as y2))")).alias("e"))
    px = lambda c, o, s: F.round((F.col(f"e.{c}") - o) * s).cast("long")
    return p.select("part", px("x", 600000.0, 2).alias("x1"), px("y", 700000.0, -2).alias("y1"), px("x2", 600000.0, 2).alias("x2"), px("y2", 700000.0, -2).alias("y2"))


sql("mask_polygon_edges", f"""with recursive {COMP_SQL}, side as (select part, r, c, unnest([-1, 0, 1, 0]) as dr, unnest([0, 1, 0, -1]) as dc, unnest([c, c + 1, c + 1, c]) as x1, unnest([r, r, r + 1, r + 1]) as y1, unnest([c + 1, c + 1, c, c]) as x2, unnest([r, r + 1, r + 1, r]) as y2 from parts)
select part, x1, y1, x2, y2 from side s where not exists (select 1 from parts n where n.part = s.part and n.r = s.r + s.dr and n.c = s.c + s.dc)""")


# ---- fan-out, names, logs


@query
def label_fanout(spark: SparkSession, d: str) -> DataFrame:
    """One row per run and label it needs a model for; a custom model has the one label custom."""
    r = table(spark, d, "run_parameters")
    own = F.when(F.col("custom_model_pth").isNotNull(), F.array(F.lit("custom"))).otherwise(F.col("labels"))
    return r.select("run_code", F.explode(own).alias("label")).filter("label is not null")


sql("label_fanout", "select run_code, label from (select run_code, unnest(case when custom_model_pth is not null then ['custom'] else labels end) as label from run_parameters) where label is not null")


@query
def label_names(spark: SparkSession, d: str) -> DataFrame:
    """Labels as the form names them, to their model names."""
    r = table(spark, d, "run_parameters").select("run_code", F.explode("labels").alias("l"), "save_vis")
    title = F.when(F.col("l") == "AO", "All archaeology").otherwise(S.capitalised(F.col("l")))
    return r.select("run_code", title.alias("title"), S.label_name(title, F.coalesce("save_vis", F.lit(False))).alias("label"))


sql("label_names", "select run_code, title, case when coalesce(save_vis, false) then case when lower(title) = 'all archaeology' then 'AO' else lower(title) end end as label from (select run_code, save_vis, case when l = 'AO' then 'All archaeology' else upper(l[1]) || lower(l[2:]) end as title from (select run_code, save_vis, unnest(labels) as l from run_parameters))")


@query
def batch_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Runs a batch of raster files makes: one file alone, several as one mosaic if so wished, else one run each."""
    r = table(spark, d, "raster").select(F.substring("raster_name", 1, 3).alias("batch"), F.col("raster_name").alias("path"), (F.col("res") < 1).alias("as_mosaic"))
    return pipeline.batch_plan(r)


sql("batch_fanout", """with r as (select substr(raster_name, 1, 3) as batch, raster_name as path, res < 1 as m from raster), n as (select batch, count(*) as n, bool_and(m) as m from r group by batch)
select batch, 'mosaic' as kind, 'mosaic:' || batch as input, n as files from n where n > 1 and m union all select r.batch, case when n = 1 then 'single' else 'each' end, path, 1 from r join n using (batch) where n = 1 or not n.m""")


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of tiles, patches and result folders."""
    g = G.bounding_grid(table(spark, d, "raster"), 1024).join(table(spark, d, "raster").select("raster_id", "raster_name", "acquired_at"), "raster_id")
    fs = S.filestem(F.col("minx"), F.col("miny"))
    return g.select("raster_id", "tile_id", S.relief_tile_name(F.col("minx"), F.col("miny")).alias("relief"), S.clip_tile_name(F.col("tile_id"), F.col("raster_name")).alias("clip"), fs.alias("filestem"),
                    S.patch_path(fs, F.col("raster_name"), "labelTxt", "txt").alias("label_path"), S.run_folder(F.col("raster_name"), F.col("acquired_at"), F.when(F.col("raster_id") % 2 == 0, "object detection").otherwise("segmentation")).alias("folder"))


sql("file_names", f"""with {_grid_sql(False).replace('512', '1024')} select raster_id, tile_id, printf('%d_%d_rvt.tif', cast(round_even(minx, 0) as bigint), cast(round_even(miny, 0) as bigint)) as relief, printf('tile_%06d_%s.tif', tile_id, raster_name) as clip,
 cast(trunc(minx) as bigint) || '_' || cast(trunc(miny) as bigint) as filestem, 'labelTxt/' || cast(trunc(minx) as bigint) || '_' || cast(trunc(miny) as bigint) || '__' || raster_name || '__labelTxt.txt' as label_path,
 raster_name || '_' || strftime(acquired_at, '%Y%m%d_%H%M%S') || case when raster_id % 2 = 0 then '_obj' else '_seg' end as folder from g join (select raster_id, raster_name, acquired_at from raster) using (raster_id)""")


@query
def stems(spark: SparkSession, d: str) -> DataFrame:
    """File stems and names before the first dot of all prediction files."""
    n = F.element_at(F.split("file_path", "/"), -1)
    return table(spark, d, "prediction_file").select("file_id", S.stem(F.col("file_path")).alias("stem"), S.before_first_dot(n).alias("name"))


sql("stems", r"select file_id, regexp_replace(b, '(.)\.[^.]*$', '\1') as stem, split_part(b, '.', 1) as name from (select file_id, string_split(file_path, '/')[-1] as b from prediction_file)")


@query
def log_units(spark: SparkSession, d: str) -> DataFrame:
    """Durations and sizes as the log prints them, over all events."""
    e = table(spark, d, "events").select("event_id", F.abs("value").alias("v"))
    return e.select("event_id", S.duration_text(F.floor("v") / 2).alias("took"), S.size_text((F.floor("v") * 123_457).cast("double")).alias("size"))


sql("log_units", """with e as (select event_id, floor(abs(value)) / 2 as s, floor(abs(value)) * 123457 as b from events)
select event_id, case when s >= 60 then printf('%.1f min', s / 60) else printf('%.1f sec', s) end as took, case when b >= 1073741824 then printf('%.2f GB', b / 1024e0 / 1024e0 / 1024e0) when b >= 1048576 then printf('%.2f MB', b / 1024e0 / 1024e0) else printf('%.2f kB', b / 1024e0) end as size from e""")


@query
def union_features(spark: SparkSession, d: str) -> DataFrame:
    """Detection and segmentation features in one relation; what one kind lacks is null."""
    a = dets(spark, d, "label", "score").select(F.lit("od").alias("kind"), F.col("det_id").alias("id"), "label", "score")
    b = segs(spark, d).select(F.lit("seg").alias("kind"), F.col("seg_id").alias("id"), F.col("arch_type").alias("label"), "dfm")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_score"), F.count("dfm").alias("n_dfm"), F.sum("id").alias("sum_id"))


sql("union_features", f"""with {DETS_SQL}, {SEGS_SQL}, u as (select 'od' as kind, det_id as id, label, score, null as dfm from dets union all select 'seg', seg_id, arch_type, null, dfm from segs)
select kind, label, count(*) as n, count(score) as n_score, count(dfm) as n_dfm, cast(sum(id) as bigint) as sum_id from u group by kind, label""")

# ---- files and whole runs

X0, Y0, RES, EPSG, NODATA = 600000.0, 700000.0, 0.5, 2157, -99999.0


def raster_files(spark: SparkSession, d: str) -> str:
    """The holed raster as files of 64 px in the shared folder, as the runs read them; gives the folder."""
    folder = f"{shared_dir(spark)}/stage-rasters-{uuid.uuid4().hex}"
    runs.write_raster_tiles(holed(spark, d), TILE_PX, folder, RES, X0, Y0, EPSG, NODATA).count()
    return folder


@query
def files_scan(spark: SparkSession, d: str) -> DataFrame:
    """Header and pixels of each raster file of a folder, read back."""
    meta = T.scan_metadata(T.list_rasters(spark, raster_files(spark, d)))
    px = T.as_pixels(T.read_tiles(meta, 50), 50).join(meta.select("path", "width", "height"), "path").filter("r < height and c < width").groupBy("path").agg(F.count(F.lit(1)).alias("n_pix"), F.count("z").alias("n_valid"), F.sum(F.col("z").cast("long")).alias("sum_z"))
    return meta.join(px, "path").select(((Y0 - F.col("y_max")) / (TILE_PX * RES)).cast("long").alias("tr"), "epsg", "res", "x_min", "y_max", "width", "height", "bands", "nodata", "n_pix", "n_valid", "sum_z")


sql("files_scan", f"""with {HOLED} select r // 64 as tr, {EPSG} as epsg, {RES}e0 as res, {X0}e0 as x_min, {Y0}e0 - (r // 64) * 32 as y_max, 64 as width, max(r) % 64 + 1 as height, 1 as bands, {NODATA}e0 as nodata, count(*) as n_pix, count(z) as n_valid, cast(sum(z) as bigint) as sum_z from holed group by r // 64""")


def mosaic_sources(spark: SparkSession, d: str) -> DataFrame:
    folder = raster_files(spark, d)
    return stage(M_.read_mosaic(spark, held(M_.mosaic_of_folder(spark, folder, f"{folder.rpartition('/')[2]}.vrt"))), "sources")


@query
def files_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 40 px with a halo of 3 over the mosaic of the files: valid pixels and their sum."""
    w = M_.mosaic_tiles(mosaic_sources(spark, d), 40, 3).select("tr", "tc", F.explode("values").alias("z")).filter("not isnan(z)")
    return w.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n_valid"), F.sum(F.col("z").cast("long")).alias("sum_z"))


sql("files_mosaic", f"""with {HOLED}, t as (select tr, tc from (select unnest(range(0, (select (max(r) + 3) // 40 + 1 from pixels))) as tr), (select unnest(range(0, 2)) as tc))
select tr, tc, count(z) as n_valid, cast(sum(z) as bigint) as sum_z from t join holed on r between tr * 40 - 3 and tr * 40 + 42 and c between tc * 40 - 3 and tc * 40 + 42 group by tr, tc having count(z) > 0""")


def relief_files(spark: SparkSession, d: str) -> str:
    """Relief tiles of 64 px made from the mosaic with its halo and written as files; gives their folder. Elevations are in ten-thousandths."""
    windows = M_.mosaic_tiles(mosaic_sources(spark, d), TILE_PX, RADIUS_PX)
    windows = windows.withColumn("values", F.transform("values", lambda v: (v / F.lit(10_000.0)).cast("float")))
    folder = held(f"{shared_dir(spark)}/stage-relief-{uuid.uuid4().hex}")
    T.write_tiles(runs.relief_tiles(windows, RADIUS_PX), folder).count()
    return folder


def _relief_pixels(spark: SparkSession, d: str) -> DataFrame:
    meta = T.scan_metadata(T.list_rasters(spark, relief_files(spark, d)))
    px = T.as_pixels(T.read_tiles(meta, TILE_PX), TILE_PX).join(meta.select("path", "x_min", "y_max"), "path")
    return px.select((F.col("r") + F.round((Y0 - F.col("y_max")) / RES)).cast("long").alias("r"), (F.col("c") + F.round((F.col("x_min") - X0) / RES)).cast("long").alias("c"), F.coalesce("z", F.lit(0.0)).alias("z"))  # 0 is the tiles' nodata


@query
def files_relief(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the relief tiles, read back from their files, in hundredths; the raster's own pixels only."""
    last = pixels(spark, d).agg(F.max("r")).first()[0]
    px = _relief_pixels(spark, d).filter(F.col("r") <= F.lit(last))
    return px.select("r", "c", F.floor(F.col("z") * 100 + 0.5 + 1e-4).cast("long").alias("v"))


sql("files_relief", f"with {SLRM_SQL} select r, c, cast(floor(v * 100 + 0.5e0 + 1e-4) as bigint) as v from vis")

AO_LEVEL, BARROW_LEVEL, BOX_LEVEL = 6_500, 3_400, 7_400


def level_score(image, label: str):
    """Stand-in for a model: high ground for one class, low for the other, around 0.5 at the levels."""
    import numpy as np

    v = np.floor(image[..., 0].astype(np.float64) * 10_000 + 0.5 + 1e-3)
    return np.where(v >= AO_LEVEL, 0.75, 0.25) if label == "AO" else np.where((v > 0) & (v <= BARROW_LEVEL), 0.5, 0.4999)


def level_boxes(image, label: str):
    """Stand-in for a detector: a box of three pixels around each pixel above the level, on half pixels, scored by its height."""
    import numpy as np

    v = np.floor(image[..., 0].astype(np.float64) * 10_000 + 0.5 + 1e-3)
    r, c = np.nonzero(v >= BOX_LEVEL)
    boxes = np.column_stack([c - 0.5, r - 0.5, c + 2.5, r + 1.5])
    return boxes, v[r, c] / 10_000 - (0.0 if label == "AO" else 0.25)


def _vector_rows(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """Features of a run's GeoPackages with the area and bounds of their outlines as read back, in hundredths and pixels."""
    from terraframe.sources.vectors import read_gpkg

    f = read_gpkg(spark, folder, folder.rpartition("/")[2], columns)
    f = Y.with_measures(with_extent(f.withColumnRenamed("area", "told")).withColumn("rings", Y.wkt_rings(F.col("geometry"))), "rings")
    px = lambda e: F.round(e / RES).cast("long")
    return f.withColumns({"area": q(F.col("area"), 100), "told": q(F.col("told"), 100), "c0": px(F.col("minx") - X0), "r0": px(Y0 - F.col("maxy")), "c1": px(F.col("maxx") - X0), "r1": px(Y0 - F.col("miny"))})


def _run(spark: SparkSession, d: str, model, **params: object) -> str:
    p = pipeline.RunParameters(labels=("AO", "barrow"), vis_exist_ok=True, **params)
    folder = held(f"{shared_dir(spark)}/stage-run-{uuid.uuid4().hex}")
    return runs.run(spark, T.list_rasters(spark, relief_files(spark, d)), p, folder, model, TILE_PX)[0]


@query
def run_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """A segmentation run from raster files to a vector file, as read back: features above 0.4 square metres."""
    f = _vector_rows(spark, _run(spark, d, level_score, ml_type="segmentation", min_area=0.4), "label string, n_pix long, area double, roundness double")
    return f.select("label", "n_pix", "area", "told", "c0", "r0", "c1", "r1")


_LEVELS = f"""lev as (select r, c, r // 64 as tr, cast(floor(cast(cast(v as float) as double) * 10000 + 0.5e0 + 1e-3) as bigint) as v from vis)"""
sql("run_segmentation", f"""with recursive {SLRM_SQL}, {_LEVELS}, m as (select 'AO' as label, r, c, tr, r * 64 + c as id from lev where v >= {AO_LEVEL} union all select 'barrow', r, c, tr, r * 64 + c from lev where v > 0 and v <= {BARROW_LEVEL}),
 e as (select a.label, a.id as a, b.id as b from m a join m b on a.label = b.label and a.tr = b.tr and ((b.r = a.r and b.c in (a.c - 1, a.c + 1)) or (b.c = a.c and b.r in (a.r - 1, a.r + 1)))),
 reach(label, id, other) as (select label, id, id from m union select reach.label, reach.id, e.b from reach join e on reach.label = e.label and reach.other = e.a),
 comp as (select label, id, min(other) as part from reach group by label, id)
select label, count(*) as n_pix, count(*) * 25 as area, count(*) * 25 as told, min(c) as c0, min(r) as r0, max(c) + 1 as c1, max(r) + 1 as r1 from m join comp using (label, id) group by label, part having count(*) * 0.25e0 > 0.4e0""")


@query
def run_detection(spark: SparkSession, d: str) -> DataFrame:
    """An object detection run from raster files over box files to a vector file, as read back."""
    f = _vector_rows(spark, _run(spark, d, level_boxes, ml_type="object detection", min_area=1.0), "label string, score double, n_boxes long, area double")
    return f.select("label", q(F.col("score")).alias("score"), "n_boxes", "area", "told", "c0", "r0", "c1", "r1")


sql("run_detection", f"""with recursive {SLRM_SQL}, {_LEVELS}, raw as (select label, tr, row_number() over (partition by label, tr order by r, c) as line_no, r % 64 as r, c, cast(printf('%.4f', v / 10000e0 - down) as double) as score from lev, (select unnest(['AO', 'barrow']) as label, unnest([0e0, 0.25e0]) as down) where v >= {BOX_LEVEL}),
 b as (select label, tr, line_no, score, cast(round_even(c - 0.5e0, 0) as bigint) as minx, cast(round_even(r - 0.5e0, 0) as bigint) + tr * 64 as miny, cast(round_even(c + 2.5e0, 0) as bigint) as maxx, cast(round_even(r + 1.5e0, 0) as bigint) + tr * 64 as maxy from raw where score > 0.5e0),
 ok as (select * from b where maxx > minx and maxy > miny),
 pair as (select a.label, a.tr, a.line_no as a, c.line_no as b, c.score, least(a.maxx, c.maxx) - greatest(a.minx, c.minx) as w, least(a.maxy, c.maxy) - greatest(a.miny, c.miny) as h from ok a join ok c on a.label = c.label and a.tr = c.tr and a.minx <= c.maxx and c.minx <= a.maxx and a.miny <= c.maxy and c.miny <= a.maxy),
 reach(label, tr, a, b) as (select label, tr, line_no, line_no from ok union select reach.label, reach.tr, reach.a, pair.b from reach join pair on reach.label = pair.label and reach.tr = pair.tr and reach.b = pair.a where pair.w + pair.h > 0),
 comp as (select label, tr, a, min(b) as part from reach group by label, tr, a),
 best as (select label, tr, a, max(score) as score from pair group by label, tr, a),
 mem as (select comp.label, comp.tr, comp.part, ok.*exclude (label, tr, score), best.score from comp join ok on ok.label = comp.label and ok.tr = comp.tr and ok.line_no = comp.a join best on best.label = comp.label and best.tr = comp.tr and best.a = comp.a),
 cell as (select label, tr, part, count(*) * 25 as area from (select distinct label, tr, part, x, unnest(range(miny, maxy)) as y from (select *, unnest(range(minx, maxx)) as x from mem)) group by label, tr, part)
select label, cast(floor(max(score) * 10000 + 0.5e0) as bigint) as score, count(*) as n_boxes, any_value(area) as area, any_value(area) as told, min(minx) as c0, min(miny) as r0, max(maxx) as c1, max(maxy) as r1 from mem join cell using (label, tr, part) group by label, tr, part having any_value(area) > 100""")


@query
def mask_files(spark: SparkSession, d: str) -> DataFrame:
    """The masks of `mask_rasterise` written as image files and read back: pixels by band and value."""
    folder = held(f"{shared_dir(spark)}/stage-masks-{uuid.uuid4().hex}")
    files = stage(runs.write_masks(mask_segments(spark, d), folder, EPSG), "mask-files")
    return runs.band_values(files).select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("patch_id"), "band", "v", "n")


sql("mask_files", f"with t as ({SQL['mask_rasterise']}) select patch_id, band, v, n from t")


@query
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the staggered training patches that show a segment, with label text and paths."""
    return pipeline.training_patches(table(spark, d, "raster"), segs(spark, d)).select("raster_id", "tile_id", "copy", "filestem", "labeltxt", "images_path", "segmentation_masks_path", "labeltxt_path")


sql("training_rows", f"""with {_grid_sql(True)}, st as (select raster_id, tile_id, k, res, minx + k * res * 256 as minx, miny + k * res * 256 as miny, maxx + k * res * 256 as maxx, maxy + k * res * 256 as maxy from g, (select unnest([0, 1]) as k)),
 num as (select *, row_number() over (order by raster_id, tile_id, k) as patch_id from st), tiles as (select patch_id, null as filestem, res, minx, miny, maxx, maxy from num), {EDGES_SQL}, {_CLIP_SQL},
 txt as (select patch_id, string_agg(line, chr(10) order by seg_id, line) as labeltxt from lines group by patch_id), f as (select num.*, raster_name, labeltxt, cast(trunc(minx) as bigint) || '_' || cast(trunc(miny) as bigint) as filestem from txt join num using (patch_id) join (select raster_id, raster_name from raster) using (raster_id))
select raster_id, tile_id, k as copy, filestem, labeltxt, 'images/' || filestem || '__' || raster_name || '__images.tif' as images_path, 'segmentation_masks/' || filestem || '__' || raster_name || '__segmentation_masks.tif' as segmentation_masks_path, 'labelTxt/' || filestem || '__' || raster_name || '__labelTxt.txt' as labeltxt_path from f""")


@query
def legacy_box_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in the older text form, classes by number; unknown numbers have no class."""
    r = box_records(spark, d).withColumns({"label": texts.legacy_label((F.col("line_no") % 5).cast("int")), "score": q(F.col("score"))})
    r = r.withColumns({c: F.col(c) / 2 for c in ("x0", "y0", "x1", "y1")})
    return texts.legacy_box_text(r).select("file_id", "line_no", "line")


sql("legacy_box_lines", f"""with {LINES_SQL} select file_id, line_no, concat_ws(' ', cast(round_even(x0 / 2, 0) as bigint), cast(round_even(y0 / 2, 0) as bigint), cast(round_even(x1 / 2, 0) as bigint), cast(round_even(y1 / 2, 0) as bigint), case line_no % 5 when 1 then 'enclosure' when 2 then 'barrow' when 3 then 'ringfort' end, cast(floor(score * 10000 + 0.5e0) as bigint)) as line from recs""")

# ---- dataset filters and measures


@query
def dataset_filters(spark: SparkSession, d: str) -> DataFrame:
    """Patches kept for ringfort training with quality 1 or 2, without empty patches."""
    obj = shown(spark, d).select("patch_id", F.col("r_arch_type").alias("label"), P.default_quality(F.col("r_dfm")).alias("dfm"))
    obj = obj.withColumn("band", F.when(F.col("label") == "barrow", 0).when(F.col("label") == "enclosure", 1).when(F.col("label") == "ringfort", 2))
    return M.keep_patches(tiles(spark, d), M.select_objects(obj, ["ringfort"], "1,2", 2), "patch_id", False).select("patch_id", "filestem")


sql("dataset_filters", f"with {SHOWN_SQL} select patch_id, filestem from tiles where patch_id in (select patch_id from shown where arch_type = 'ringfort' and coalesce(dfm, 1) in (1, 2))")


@query
def spatial_split(spark: SparkSession, d: str) -> DataFrame:
    """Geographic 60:20:20 split of the patches by blocks of 2 km."""
    return M.spatial_split(tiles(spark, d), 2000.0).select("patch_id", "split")


sql("spatial_split", f"with {TILES_SQL}, k as (select patch_id, (cast(floor(minx / 2000) as bigint) * 7919 + cast(floor(miny / 2000) as bigint) * 104729) % 100 as k from tiles) select patch_id, case when k < 60 then 'train' when k < 80 then 'validation' else 'test' end as split from k")


@query
def pixel_iou(spark: SparkSession, d: str) -> DataFrame:
    """IoU of the relief mask against the elevation mask, by column block, in millionths."""
    v = relief(spark, d).select(F.floor(F.col("c") / 16).cast("long").alias("cls"), F.coalesce(F.col("z") >= 0, F.lit(False)).alias("t"), (q(F.col("v"), 1_000_000) >= 500_000).alias("p"))
    return M.pixel_iou(v, "cls", "t", "p").select("cls", "tp", "fp", "fn", q(F.col("iou"), 1_000_000).alias("iou"))


sql("pixel_iou", f"""with {SLRM_SQL}, v as (select c // 16 as cls, coalesce(z >= 0, false) as t, cast(floor(v * 1000000 + 0.5e0) as bigint) >= 500000 as p from vis),
 n as (select cls, count(*) filter (t and p) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from v group by cls) select cls, tp, fp, fn, cast(floor(cast(tp as double) / (tp + fp + fn) * 1000000 + 0.5e0) as bigint) as iou from n""")


@query
def box_map(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of the detections against the segments, per label, in millionths."""
    pred = dets(spark, d, "label", "score").filter("score is not null and not isnan(score)").select(F.col("det_id").alias("id"), "label", "score", *BOUNDS)
    truth = segs(spark, d).filter("maxx > minx and maxy > miny").select(F.col("seg_id").alias("id"), F.lower("arch_type").alias("label"), *BOUNDS).distinct()
    return M.average_precision(pred, truth, 64.0, 0.3).select("label", "predictions", "truths", "hits", q(F.col("ap"), 1_000_000).alias("ap"))


sql("box_map", f"""with {DETS_SQL}, {SEGS_SQL}, pr as (select det_id as id, label, score, minx, miny, maxx, maxy from dets where score is not null and not isnan(score)), tr as (select distinct seg_id as id, lower(arch_type) as label, minx, miny, maxx, maxy from segs where maxx > minx and maxy > miny),
 met as (select p.id, t.id as tid, greatest(0, least(p.maxx, t.maxx) - greatest(p.minx, t.minx)) * greatest(0, least(p.maxy, t.maxy) - greatest(p.miny, t.miny)) as i, (p.maxx - p.minx) * (p.maxy - p.miny) + (t.maxx - t.minx) * (t.maxy - t.miny) as s from pr p join tr t on p.label = t.label and p.minx <= t.maxx and t.minx <= p.maxx and p.miny <= t.maxy and t.miny <= p.maxy),
 best as (select id, tid from (select id, tid, row_number() over (partition by id order by i / (s - i) desc, tid) as k from met where i / (s - i) >= 0.3e0) where k = 1),
 h as (select p.*, case when row_number() over (partition by p.label, b.tid order by score desc, p.id) = 1 and b.tid is not null then 1 else 0 end as hit from pr p left join best b using (id)),
 rk as (select *, row_number() over w as n, sum(hit) over (w rows between unbounded preceding and current row) as k from h window w as (partition by label order by score desc, id))
select t.label, coalesce(g.n, 0) as predictions, t.n as truths, cast(coalesce(g.hits, 0) as bigint) as hits, cast(floor(coalesce(g.s, 0) / t.n * 1000000 + 0.5e0) as bigint) as ap from (select label, count(*) as n from tr group by label) t left join (select label, count(*) as n, sum(hit) as hits, sum(case when hit = 1 then k / n end) as s from rk group by label) g using (label)""")

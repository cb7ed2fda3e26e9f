"""Tile grids over rasters: plain, target-aligned and staggered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.scalars import snap_down, snap_up


def _steps(length: Column, step: Column) -> Column:
    """0 .. number of steps that begin within the length; empty for no length."""
    n = F.ceil(length / step).cast("long")
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def bounding_grid(rasters: DataFrame, tile_px: int, tag: bool = False) -> DataFrame:
    """Square tiles over each raster (raster_id, res, x_min, y_max, width, height).

    Columns go from left to right, rows from the top; the last ones hang over
    and are never clipped. With `tag`, the left and top edges are snapped
    outwards to whole tiles. tile_id counts column by column from 0, which is
    the order by minx, then falling maxy. Rasters with a null or zero size or
    resolution give no tiles.
    """
    r = rasters.filter("res > 0 and width > 0 and height > 0").withColumn("t", F.col("res") * tile_px)
    left, top = F.col("x_min"), F.col("y_max")
    right, bottom = left + F.col("width") * F.col("res"), top - F.col("height") * F.col("res")
    if tag:
        left, top = snap_down(left, F.col("t")), snap_up(top, F.col("t"))
    r = r.withColumns({"x": left, "y": top, "w": right - left, "h": top - bottom})
    r = r.withColumn("rows", F.ceil(F.col("h") / F.col("t")).cast("long"))
    r = r.withColumn("ix", F.explode(_steps(F.col("w"), F.col("t")))).withColumn("iy", F.explode(_steps(F.col("h"), F.col("t"))))
    minx, maxy = F.col("x") + F.col("ix") * F.col("t"), F.col("y") - F.col("iy") * F.col("t")
    return r.select("raster_id", (F.col("ix") * F.col("rows") + F.col("iy")).alias("tile_id"), minx.alias("minx"), (maxy - F.col("t")).alias("miny"), (minx + F.col("t")).alias("maxx"), maxy.alias("maxy"))


def staggered_grid(rasters: DataFrame, tile_px: int, stagger_px: int | None) -> DataFrame:
    """Target-aligned tiles, each followed by a copy moved right and up by the stagger: column `copy` 0 or 1."""
    g = bounding_grid(rasters, tile_px, tag=True)
    if not stagger_px:
        return g.withColumn("copy", F.lit(0))
    s = rasters.select("raster_id", (F.col("res") * stagger_px).alias("s"))
    g = g.join(s, "raster_id").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    move = F.col("copy") * F.col("s")
    return g.select("raster_id", "tile_id", "copy", *[(F.col(c) + move).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def extents(grid: DataFrame) -> DataFrame:
    """raster_id, tile_id and the four bounds as one struct (left, bottom, right, top)."""
    return grid.select("raster_id", "tile_id", F.struct(F.col("minx").alias("left"), F.col("miny").alias("bottom"), F.col("maxx").alias("right"), F.col("maxy").alias("top")).alias("extent"))


def outline_tiles(valid: DataFrame, tile: int) -> DataFrame:
    """Tiles (tr, tc) of `tile` pixels that meet a valid pixel (r, c), touching edges and corners included."""
    span = lambda c: F.explode(F.sequence(F.ceil((F.col(c) - tile) / tile).cast("long"), F.floor((F.col(c) + 1) / tile).cast("long")))
    return valid.select(span("r").alias("tr"), "c").select("tr", span("c").alias("tc")).distinct()


def in_windows(pixels: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """Each pixel (r, c, ...) once per tile (tr, tc) whose window with halo holds it; tiles start at 0."""
    span = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("long"), F.floor((F.col(c) + halo) / tile).cast("long")))
    return pixels.withColumn("tr", span("r")).withColumn("tc", span("c"))


def footprints(tiles: DataFrame) -> DataFrame:
    """One box per tile of stored tiles (tile_id, res, x_min, y_max, width, height)."""
    return tiles.select("tile_id", F.col("x_min").alias("minx"), (F.col("y_max") - F.col("height") * F.col("res")).alias("miny"),
                        (F.col("x_min") + F.col("width") * F.col("res")).alias("maxx"), F.col("y_max").alias("maxy"))

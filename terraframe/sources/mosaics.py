"""Mosaics of raster files: an index file over many tiles, read back window by window."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.plans import tasks
from terraframe.sources.geotiff import header, list_rasters, metadata, open_file, read_window, scan_metadata

_SOURCES = "seq long, path string, res double, x_min double, y_max double, width int, height int"


def _out(path: str):
    from pyarrow import fs

    plain = path.removeprefix("file:") if path.startswith("file:") else path
    where, at = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
    return where.open_output_stream(at)


def write_mosaic(rasters: DataFrame, target: str) -> str:
    """Write a virtual raster (VRT) over the files of `scan_metadata` to `target`, and give its path.

    Sources stand in the order of their paths: of overlapping ones the last
    shows. All must have one resolution and projection. The sources stream
    through the driver a partition at a time; no pixel is read. No files: an error.
    """
    ext = rasters.agg(
        F.min("x_min").alias("x0"), F.max("y_max").alias("y1"), F.max(F.expr("x_min + width * res")).alias("x1"), F.min(F.expr("y_max - height * res")).alias("y0"),
        F.min("res").alias("res"), F.max("res").alias("most"), F.min("epsg").alias("epsg"), F.max("epsg").alias("other"), F.max("nodata").alias("nodata"), F.count(F.lit(1)).alias("n")).first()
    if not ext.n:
        raise ValueError("a mosaic needs at least one file")
    if ext.res != ext.most or ext.epsg != ext.other:
        raise ValueError("the files of a mosaic must have one resolution and projection")
    width, height = round((ext.x1 - ext.x0) / ext.res), round((ext.y1 - ext.y0) / ext.res)
    with _out(target) as f:
        put = lambda s: f.write(s.encode())
        put(f'<VRTDataset rasterXSize="{width}" rasterYSize="{height}">\n  <SRS>EPSG:{ext.epsg}</SRS>\n  <GeoTransform>{ext.x0!r}, {ext.res!r}, 0.0, {ext.y1!r}, 0.0, {-ext.res!r}</GeoTransform>\n  <VRTRasterBand dataType="Float32" band="1">\n')
        if ext.nodata is not None:
            put(f"    <NoDataValue>{ext.nodata!r}</NoDataValue>\n")
        for r in rasters.orderBy("path").toLocalIterator():
            x, y = round((r.x_min - ext.x0) / ext.res), round((ext.y1 - r.y_max) / ext.res)
            put(f'    <SimpleSource>\n      <SourceFilename relativeToVRT="0">{escape(r.path)}</SourceFilename>\n      <SourceBand>1</SourceBand>\n'
                f'      <SrcRect xOff="0" yOff="0" xSize="{r.width}" ySize="{r.height}"/>\n      <DstRect xOff="{x}" yOff="{y}" xSize="{r.width}" ySize="{r.height}"/>\n    </SimpleSource>\n')
        put("  </VRTRasterBand>\n</VRTDataset>\n")
    return target


def mosaic_of_folder(spark: SparkSession, folder: str, name: str) -> str:
    """Mosaic of all raster files in a folder; the index file lies beside the folder."""
    return write_mosaic(scan_metadata(list_rasters(spark, folder)), f"{folder.rstrip('/').rpartition('/')[0]}/{name}")


def read_mosaic(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a virtual raster in their order: seq, path, res, x_min, y_max, width, height. The file is parsed source by source in one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                rows, seq, at, geo, src = [], 0, None, None, None
                with open_file(p) as f:
                    for _, e in ET.iterparse(f, events=("end",)):
                        if e.tag == "GeoTransform":
                            geo = [float(v) for v in e.text.split(",")]
                        elif e.tag == "SourceFilename":
                            src = e.text
                        elif e.tag == "DstRect":
                            at = [round(float(e.get(k))) for k in ("xOff", "yOff", "xSize", "ySize")]
                        elif e.tag in ("SimpleSource", "ComplexSource"):
                            rows.append((seq, src, geo[1], geo[0] + at[0] * geo[1], geo[3] - at[1] * geo[1], at[2], at[3]))
                            seq += 1
                            e.clear()
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SOURCES.split(", ")])
                            rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SOURCES.split(", ")])

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, _SOURCES)


def mosaic_tiles(sources: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """Windows of `tile` pixels with a halo over a mosaic, as `geotiff.read_tiles` gives them for one raster: tr, tc, rows, cols, bands, values, epsg, res, x_min, y_max.

    sources: seq, path, res, x_min, y_max, width, height of one grid of pixels.
    Each source is read only where windows meet it; the pieces of a window, at
    most its own size, meet in one task, the last in `seq` on top, nodata never
    above a value. Windows that no source meets have no row.
    """
    ext = sources.agg(F.min("x_min").alias("x0"), F.max("y_max").alias("y1"), F.min("res").alias("res")).first()
    if ext.res is None:
        return sources.sparkSession.createDataFrame([], "tr int, tc int, rows int, cols int, bands int, values array<float>, epsg int, res double, x_min double, y_max double")
    side, res, x0, y1 = tile + 2 * halo, float(ext.res), float(ext.x0), float(ext.y1)
    off = lambda c: F.round(c / F.lit(res)).cast("int")
    s = sources.select("seq", "path", off(F.col("x_min") - x0).alias("c0"), off(F.lit(y1) - F.col("y_max")).alias("r0"), "width", "height")
    span = lambda at, n: F.explode(F.expr(f"sequence(cast(greatest(0, floor(({at} - {halo}) / {tile})) as int), cast(floor(({at} + {n} - 1 + {halo}) / {tile}) as int))"))
    w = s.withColumn("tr", span("r0", "height")).withColumn("tc", span("c0", "width"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, g in b.groupby("path"):
                with open_file(path) as f:
                    h = header(f)
                    _, epsg, *_, nodata = metadata(path, h)
                    for t in g.itertuples(index=False):
                        lo_r, lo_c = t.tr * tile - halo, t.tc * tile - halo
                        a, b_, c, d = max(0, lo_r - t.r0), min(t.height, lo_r + side - t.r0), max(0, lo_c - t.c0), min(t.width, lo_c + side - t.c0)
                        if a < b_ and c < d:
                            v = read_window(f, h, a, b_, c, d)[..., 0]
                            v = np.where(v == nodata, np.nan, v) if nodata is not None else v
                            yield pd.DataFrame({"tr": [t.tr], "tc": [t.tc], "seq": [t.seq], "r": [a + t.r0 - lo_r], "c": [c + t.c0 - lo_c], "h": [b_ - a], "w": [d - c], "v": [v.astype(np.float32).ravel()], "epsg": pd.array([epsg], "Int32")})

    def join(p: pd.DataFrame) -> pd.DataFrame:
        out = np.full((side, side), np.nan, np.float32)
        for k in p.sort_values("seq").itertuples(index=False):
            v, at = np.asarray(k.v, np.float32).reshape(k.h, k.w), out[k.r:k.r + k.h, k.c:k.c + k.w]
            np.copyto(at, v, where=~np.isnan(v))
        tr, tc = int(p["tr"].iloc[0]), int(p["tc"].iloc[0])
        return pd.DataFrame({"tr": [tr], "tc": [tc], "rows": [side], "cols": [side], "bands": [1], "values": [out.ravel()], "epsg": pd.array([p["epsg"].iloc[0]], "Int32"), "res": [res], "x_min": [x0 + tc * tile * res], "y_max": [y1 - tr * tile * res]})

    pieces = w.repartition(tasks(w), "path", "tr", "tc").mapInPandas(read, "tr int, tc int, seq long, r int, c int, h int, w int, v array<float>, epsg int")
    return pieces.groupBy("tr", "tc").applyInPandas(join, "tr int, tc int, rows int, cols int, bands int, values array<float>, epsg int, res double, x_min double, y_max double")

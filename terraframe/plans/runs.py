"""Whole runs on raster files: tiles written, scored and turned to features, vector files, training files, the run's log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions import scalars as S
from terraframe.operators import archive as A
from terraframe.operators import boxes as B
from terraframe.operators import patches as P
from terraframe.operators import raster as R
from terraframe.plans import held, stage, tasks
from terraframe.plans.pipeline import RunParameters, duration
from terraframe.sources import geotiff as T
from terraframe.sources import mosaics as M
from terraframe.sources.texts import LEGACY_CLASSES
from terraframe.sources.vectors import write_gpkg

TILE_PX = 1024
_TILE = "name string, rows int, cols int, bands int, values array<float>, epsg int, res double, x_min double, y_max double, nodata double"
Score = Callable[[np.ndarray, str], np.ndarray]  # (rows, cols, 3) values and a label -> probabilities (rows, cols)
Detect = Callable[[np.ndarray, str], tuple[np.ndarray, np.ndarray]]  # the same -> boxes (n, 4) in pixels, scores (n)


def three_bands(a: np.ndarray) -> np.ndarray:
    """Image of (rows, cols, bands) as models take it: one band is repeated to three."""
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a


def _images(tiles: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows that `make` gives of each tile and its array (rows, cols, bands)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples(index=False):
                out = make(t, np.asarray(t.values, np.float32).reshape(t.rows, t.cols, t.bands))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return tiles.mapInPandas(run, schema)


def relief_tiles(windows: DataFrame, radius: int) -> DataFrame:
    """Relief images, ready for `write_tiles`, of windows read with a halo of `radius`; nodata 0. Windows without a valid pixel of their own are left out."""
    def make(t, a: np.ndarray) -> list[tuple]:
        if np.isnan(a[radius:a.shape[0] - radius, radius:a.shape[1] - radius]).all():
            return []
        v = R.relief_tile(a[..., 0].astype(np.float64), radius).astype(np.float32)
        return [(f"{t.x_min:.0f}_{t.y_max - v.shape[0] * t.res:.0f}_rvt.tif", *v.shape, 1, v.ravel(), t.epsg, t.res, t.x_min, t.y_max, 0.0)]

    return _images(windows, make, _TILE)


def clipped_tiles(windows: DataFrame, stem: str, rows_of_tiles: int) -> DataFrame:
    """Images of windows read without halo, held to [0, 1], nodata 0, numbered column by column. Windows without a valid pixel are left out."""
    def make(t, a: np.ndarray) -> list[tuple]:
        if np.isnan(a).all():
            return []
        v = np.nan_to_num(np.clip(a, 0.0, 1.0), nan=0.0)
        return [(f"tile_{t.tc * rows_of_tiles + t.tr:06}_{stem}.tif", *v.shape, v.ravel(), t.epsg, t.res, t.x_min, t.y_max, 0.0)]

    return _images(windows, make, _TILE)


def tile_images(spark: SparkSession, folder: str) -> DataFrame:
    """Each raster file of a folder whole: path and the columns of `read_tiles`. Files are tiles, so each fits a task."""
    meta = T.scan_metadata(T.list_rasters(spark, folder))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with T.open_file(p) as f:
                    h = T.header(f)
                    _, epsg, res, x_min, y_max, width, height, _, _ = T.metadata(p, h)
                    a = T.read_window(f, h, 0, height, 0, width)
                    yield pd.DataFrame({"path": [p], "rows": [height], "cols": [width], "bands": [a.shape[2]], "values": [a.astype(np.float32).ravel()], "epsg": pd.array([epsg], "Int32"), "res": [res], "x_min": [x_min], "y_max": [y_max]})

    return meta.select("path").repartition(tasks(meta), "path").mapInPandas(run, "path string, rows int, cols int, bands int, values array<float>, epsg int, res double, x_min double, y_max double")


def write_masks(shown: DataFrame, folder: str, epsg: int | None = None, patch: str = "patch_id", band: str = "band", value: str = "dfm", order: str = "seq") -> DataFrame:
    """Write the masks of `patches.burn_masks` as files `<patch>.tif`; gives patch, path and n_bytes of each.

    A mask is written by the task that paints it and let go then, none goes
    through the engine. Runs when the result is read; a rerun of a task writes
    the same files again.
    """
    def make(masks: Iterator[tuple[int, np.ndarray, tuple]]) -> Iterator[tuple]:
        where, base = T.made_folder(folder)
        for p, m, (x_min, y_max, res) in masks:
            data = T.encode(m, res, x_min, y_max, epsg)
            with where.open_output_stream(f"{base}/{p}.tif") as f:
                f.write(data)
            yield p, f"{folder}/{p}.tif", len(data)

    return P.painted(shown, patch, band, value, order, make, "p long, path string, n_bytes long")


def band_values(paths: DataFrame) -> DataFrame:
    """(path, band, v, n): pixels of each value from 1 to 255 by band of raster files (path), counted where they are read, block by block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                with T.open_file(p) as f:
                    h = T.header(f)
                    bands = T.layout(h).bands
                    n = np.zeros(bands * 256, np.int64)
                    for a in T.blocks(f, h):
                        v = a.astype(np.uint8, copy=False).ravel()
                        i = np.flatnonzero(v != 0)
                        n += np.bincount(i % bands * 256 + v[i], minlength=len(n))
                out += [(p, k // 256, k % 256, int(n[k])) for k in np.flatnonzero(n).tolist()]
            yield pd.DataFrame(out, columns=["path", "band", "v", "n"])

    return paths.select("path").repartition(tasks(paths), "path").mapInPandas(run, "path string, band int, v int, n long")


def box_texts(images: DataFrame, labels: tuple[str, ...], detect: Detect) -> DataFrame:
    """(name, text): the box file of each image and label, also of those without a box.

    Pixels are rounded with ties to even, scores written with four decimals.
    """
    def make(t, a: np.ndarray) -> list[tuple]:
        stem, out = t.path.rpartition("/")[2].rpartition(".")[0], []
        for label in labels:
            boxes, scores = detect(three_bands(a), label)
            geo = f"{t.epsg} {t.res!r} {t.x_min!r} {t.y_max!r}"
            out.append((f"{label}/{stem}_{label}_bounding_boxes.txt", "".join(f"{' '.join(str(round(v)) for v in b)} {label} {s:.4f} {geo}\n" for b, s in zip(boxes.tolist(), scores.tolist(), strict=True))))
        return out

    return _images(images, make, "name string, text string")


def legacy_box_texts(images: DataFrame, detect: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(name, text) in the older form: one detector for all classes gives boxes, class numbers and scores; the file name ends at the first dot."""
    def make(t, a: np.ndarray) -> list[tuple]:
        boxes, numbers, scores = detect(three_bands(a))
        lines = "".join(f"{' '.join(str(round(v)) for v in b)} {LEGACY_CLASSES[k]} {s!r}\n" for b, k, s in zip(boxes.tolist(), numbers.tolist(), scores.tolist(), strict=True))
        return [(t.path.rpartition("/")[2].partition(".")[0] + ".txt", lines)]

    return _images(images, make, "name string, text string")


def probability_tiles(images: DataFrame, labels: tuple[str, ...], score: Score) -> DataFrame:
    """Probability images, ready for `write_tiles`, of each image and label."""
    def make(t, a: np.ndarray) -> list[tuple]:
        stem = t.path.rpartition("/")[2].rpartition(".")[0]
        return [(f"{stem}_{label}.tif", *(p := np.asarray(score(three_bands(a), label), np.float32)).shape, 1, p.ravel(), t.epsg, t.res, t.x_min, t.y_max, None) for label in labels]

    return _images(images, make, _TILE)


def mask_features(images: DataFrame, label: str, least: float = 0.5) -> DataFrame:
    """Features of probability images: label, prediction_path, n_pix, area, roundness and the outline as polygon text; parts end with their image."""
    def make(t, a: np.ndarray) -> list[tuple]:
        r, c = np.nonzero(a[..., 0] >= least)
        first, out = R.label_components(r, c), []
        for k in R._by_part(first):
            rings = ", ".join("(" + ", ".join(f"{t.x_min + x * t.res!r} {t.y_max - y * t.res!r}" for x, y in ring) + ")" for ring in R.outline(r[k], c[k]))
            area, hull = len(k) * t.res * t.res, R.part_hull(r[k], c[k]) * t.res
            out.append((label, "/".join(t.path.split("/")[-3:]), len(k), area, 4 * np.pi * area / hull**2, f"POLYGON ({rings})"))
        return out

    return _images(images, make, "label string, prediction_path string, n_pix long, area double, roundness double, geometry string")


def box_features(files: DataFrame, keep_paths: bool = False, geometry: bool = True) -> DataFrame:
    """Features of box files (file_path, content): label (the file's first), score, n_boxes, area, outline, and with `keep_paths` prediction_path."""
    files = files.withColumn("file_id", F.xxhash64("file_path"))
    r = A.box_lines(files.select("file_id", "content")).withColumnRenamed("line_no", "box_no")
    found = B.confident(B.world_boxes(r))
    f = B.part_features(found, "file_id", geometry=geometry)
    names = found.groupBy("file_id").agg(F.min_by("label", "box_no").alias("label"))
    if keep_paths:
        names = names.join(files.select("file_id", S.path_tail(F.col("file_path")).alias("prediction_path")), "file_id")
    return f.join(names, "file_id").drop("file_id", "part")


def training_files(patches: DataFrame, shown: DataFrame, folder: str) -> DataFrame:
    """Write image, mask and label text of training patches; gives kind, path and n_bytes of each file.

    patches: patch_id, bounds, res, labeltxt, images_path, segmentation_masks_path,
    labeltxt_path and path, the raster file. shown: see `patches.burn_masks`.
    Images are cut from the raster and held to [0, 1].
    """
    from terraframe.sources.texts import write_texts

    size = P.pixel_size(patches)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, g in b.groupby("path"):
                with T.open_file(path) as f:
                    h = T.header(f)
                    _, epsg, res, x_min, y_max, *_, nodata = T.metadata(path, h)
                    for t in g.itertuples(index=False):
                        r, c = round((y_max - t.maxy) / res), round((t.minx - x_min) / res)
                        a = T.read_window(f, h, r, r + t.n_rows, c, c + t.n_cols)
                        a = np.where(a == nodata, np.nan, a) if nodata is not None else a
                        v = np.nan_to_num(np.clip(a, 0.0, 1.0), nan=0.0).astype(np.float32)
                        yield pd.DataFrame([(t.images_path, *v.shape, v.ravel(), epsg, res, t.minx, t.maxy, 0.0)], columns=[x.split()[0] for x in _TILE.split(", ")])

    images = size.select("path", "images_path", "minx", "maxy", "n_rows", "n_cols").repartition(tasks(size), "path", "images_path").mapInPandas(cut, _TILE)
    masks = P.burn_masks(shown).join(patches.select("patch_id", "segmentation_masks_path"), "patch_id").select(
        F.col("segmentation_masks_path").alias("name"), F.col("n_rows").cast("int").alias("rows"), F.col("n_cols").cast("int").alias("cols"), F.lit(P.MAX_CLASSES).alias("bands"), F.col("mask").alias("values"),
        F.lit(None).cast("int").alias("epsg"), "res", F.col("minx").alias("x_min"), F.col("maxy").alias("y_max"), F.lit(None).cast("double").alias("nodata"))
    texts = patches.select(F.col("labeltxt_path").alias("name"), F.col("labeltxt").alias("text"))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), F.concat(F.lit(folder + "/"), "name").alias("path"), "n_bytes")
    return kind(T.write_tiles(images, folder), "image").unionByName(kind(T.write_tiles(masks, folder), "mask")).unionByName(kind(write_texts(texts, folder), "labels"))


@dataclass
class RunLog:
    """The run's log: a stamped header, then a section for each stage; `text` is the whole."""

    title: str
    started: float = field(default_factory=time.time)
    lines: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lines += ["=" * 80, self.title, "", "Processing log - " + time.strftime("%d/%m/%Y %H:%M:%S", time.localtime(self.started)), ""]

    def note(self, message: str) -> None:
        self.lines.append(time.strftime("[%Y-%m-%d %H:%M:%S] ", time.localtime()) + message)

    def section(self, name: str, facts: dict[str, object], seconds: float | None = None) -> None:
        """Facts as name and value lines; a list takes a line for each; what is None has no line."""
        self.lines += ["=" * 80, f"{name.capitalize()} log:", ""]
        for k, v in facts.items():
            if isinstance(v, list | tuple):
                self.lines += [f"    {k}:", *[f"      > {x}" for x in v]]
            elif v is not None:
                self.lines.append(f"    {k}: {'YES' if v is True else 'NO' if v is False else v}")
        if seconds is not None:
            self.lines += ["", f"TIME: {duration(seconds)}"]
        self.lines.append("")

    def image(self, spark: SparkSession, paths: DataFrame) -> None:
        """Path, size, projection and bytes of the input, from headers and the file listing."""
        m = T.scan_metadata(paths).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.max("width").alias("w"), F.max("height").alias("h"), F.min("epsg").alias("epsg")).first()
        sizes = spark.read.format("binaryFile").load(m.path).select("length").first()
        self.section("image", {"file": m.path, "files": m.n, "image size": f"{m.w}x{m.h} pixels", "CRS": f"EPSG:{m.epsg}", "size": size_text(sizes.length)})

    def end(self) -> str:
        self.lines += ["=" * 80, f"TOTAL TIME: {duration(time.time() - self.started)}"]
        return self.text

    @property
    def text(self) -> str:
        return "\n".join(self.lines) + "\n"


def size_text(n: int) -> str:
    """A number of bytes in kB, MB or GB (powers of 1024), two decimals."""
    unit, k = next(((u, k) for u, k in (("GB", 3), ("MB", 2)) if n >= 1024**k), ("kB", 1))
    return f"{n / 1024**k:.2f} {unit}"


def run(spark: SparkSession, rasters: DataFrame, params: RunParameters, folder: str, model: Score | Detect, tile: int = TILE_PX, name: str = "run") -> tuple[str, RunLog]:
    """A detection run over the files of one raster or mosaic (path); gives the vector files' folder, "" where nothing was found, and the log.

    Tiles of relief, or of the given visualisation, are written to `folder`
    with a mosaic over them; the model scores them once per label; box files or
    probability images are written, merged or traced to features, held against
    roundness and area, and written as GeoPackages. What the parameters do not
    ask to keep is deleted. A custom model's file must exist.
    """
    if params.ml_type is None or not params.model_labels:
        raise ValueError("the run needs a kind and labels")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = lambda p: (at := hadoop.Path(p)).getFileSystem(conf).exists(at)
    drop = lambda p: (at := hadoop.Path(p)).getFileSystem(conf).delete(at, True)
    if params.custom_model_pth and not files(params.custom_model_pth):
        raise ValueError(f"no model at {params.custom_model_pth}")
    log = RunLog(name)
    log.image(spark, rasters.select("path"))
    t = time.time()
    meta = stage(T.scan_metadata(rasters.select("path")), "meta")
    res = meta.agg(F.min("res")).first()[0]
    sources = meta.orderBy("path").withColumn("seq", F.monotonically_increasing_id())  # grows with the path
    vis = f"{folder}/{'tiled_image' if params.vis_exist_ok else 'slrm'}"
    radius = 0 if params.vis_exist_ok else int(max(10, -(-10 // res)))
    windows = M.mosaic_tiles(sources, tile, radius)
    down = meta.agg(F.ceil((F.max("y_max") - F.min(F.expr("y_max - height * res"))) / F.lit(res * tile))).first()[0]
    tiles = clipped_tiles(windows, name, int(down)) if params.vis_exist_ok else relief_tiles(windows, radius)
    n = T.write_tiles(tiles, vis).count()
    if not n:
        log.section("visualizations", {"tiles count": 0}, time.time() - t)
        return "", log
    vrt = M.mosaic_of_folder(spark, vis, f"{vis.rpartition('/')[2]}.vrt")
    log.section("visualizations", {"source": "given visualisation" if params.vis_exist_ok else "made from elevation", "save visualization": bool(params.save_vis), "tiles location": vis if params.save_vis else None, "tiles count": n if params.save_vis else None, "VRT file path": vrt if params.save_vis else None}, time.time() - t)
    log.section("inference", {"ML method": "Semantic segmentation" if params.ml_type == "segmentation" else "Object detection", "ML model": "custom" if params.custom_model_pth else "own", "Path": params.custom_model_pth, "Selected classes": params.model_labels})
    t, images, raw = time.time(), tile_images(spark, vis), []
    if params.ml_type == "object detection":
        from terraframe.sources.texts import write_texts

        kept = f"{folder}/predictions_object_detection"
        write_texts(box_texts(images, params.model_labels, model), kept).count()
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(kept).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"))
        found, raw = B.at_least(box_features(texts, bool(params.save_ml_output)), "area", params.min_area), [kept]
    else:
        found = None
        for label in params.model_labels:
            kept = f"{folder}/predictions_segmentation_{label}"
            T.write_tiles(probability_tiles(images, (label,), model), kept).count()
            f = mask_features(tile_images(spark, kept), label)
            found = f if found is None else found.unionByName(f)
            raw.append(kept)
        found = B.at_least(B.at_least(found, "roundness", params.roundness), "area", params.min_area)
        found = found if params.save_ml_output else found.drop("prediction_path")
    found = stage(found, "features")
    out = "" if found.isEmpty() else f"{folder}/{'semantic_segmentation' if params.ml_type == 'segmentation' else 'object_detection'}"
    if out:
        write_gpkg(found, out, out.rpartition("/")[2]).count()
    saved = []
    for at in raw:
        if not params.save_ml_output:
            drop(at)
        else:
            saved.append(M.mosaic_of_folder(spark, at, f"{at.rpartition('/')[2]}.vrt") if params.ml_type == "segmentation" else at)
    if not params.save_vis:
        drop(vis)
        drop(vrt)
    log.section("results", {"Minimum area [m^2]": params.min_area, "Minimum roundness [-]": params.roundness if params.ml_type == "segmentation" else None, "Results vector files": [out or "none"], "Save RAW results": bool(saved), "RAW results": saved or None}, time.time() - t)
    log.end()
    return out, log


def write_raster_tiles(pixels: DataFrame, tile: int, folder: str, res: float, x_min: float, y_max: float, epsg: int, nodata: float) -> DataFrame:
    """Pixel rows (r, c, z) as raster files of `tile` pixels, null as nodata; gives path, name and n_bytes. Each file's pixels meet in one task."""
    def one(p: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(p["tr"].iloc[0]), int(p["tc"].iloc[0])
        r, c = p["r"].to_numpy() - tr * tile, p["c"].to_numpy() - tc * tile
        a = np.full((int(r.max()) + 1, int(c.max()) + 1), nodata, np.float32)
        z = p["z"].to_numpy(float)
        a[r, c] = np.where(np.isnan(z), nodata, z)
        return pd.DataFrame([(f"z_{tr:05}_{tc:05}.tif", *a.shape, 1, a.ravel(), epsg, res, x_min + tc * tile * res, y_max - tr * tile * res, nodata)], columns=[x.split()[0] for x in _TILE.split(", ")])

    p = pixels.select("r", "c", F.col("z").cast("double").alias("z"), F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"))
    held(folder)
    return T.write_tiles(p.groupBy("tr", "tc").applyInPandas(one, _TILE), folder)

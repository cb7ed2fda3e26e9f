"""Runs on relations: detection over pixels or records, training patches, batches and parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import scalars as S
from terraframe.operators import boxes as B
from terraframe.operators import grid as G
from terraframe.operators import patches as P
from terraframe.operators import raster as R
from terraframe.operators.polygon import polygon_semi_join
from terraframe.sources.geotiff import read_tiles

KINDS = ("segmentation", "object detection")
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class RunParameters:
    """Parameters of a detection run. Checked when made, before any work."""

    dem_path: str | None = None
    vis_exist_ok: bool | None = None
    save_vis: bool | None = None
    ml_type: str | None = None
    labels: tuple[str, ...] | None = None
    ml_model_custom: str | None = None
    custom_model_pth: str | None = None
    roundness: float | None = None
    min_area: float | None = None
    save_ml_output: bool | None = None
    out_dir: str | None = None
    tiles_to_vrt: bool | None = None
    input_file_list: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.ml_type is not None and self.ml_type not in KINDS:
            raise ValueError(f"ml_type must be one of {KINDS}")
        for name, most in (("roundness", 1.0), ("min_area", float("inf"))):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= most:
                raise ValueError(f"{name} is out of range")
        if self.ml_model_custom == "Custom model" and not (self.custom_model_pth or "").endswith(".tar"):
            raise ValueError("a custom model needs the path of a .tar file")

    def updated(self, **changes: object) -> RunParameters:
        """A copy with the known names changed; unknown names are passed over."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})

    @property
    def model_labels(self) -> tuple[str, ...]:
        return ("custom",) if self.custom_model_pth else tuple(self.labels or ())

    @property
    def output_folder(self) -> str:
        """out_dir, or the folder of the image."""
        return self.out_dir or (self.dem_path or "").rpartition("/")[0] or "."


def batch_plan(files: DataFrame) -> DataFrame:
    """Runs of a batch (batch, path, as_mosaic): batch, kind (single, mosaic, each), input, files. Empty batches make none."""
    n = files.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("as_mosaic").alias("m"))
    whole = n.filter("n > 1 and m").select("batch", F.lit("mosaic").alias("kind"), F.concat(F.lit("mosaic:"), "batch").alias("input"), F.col("n").alias("files"))
    each = files.join(n.filter("n = 1 or not m"), "batch").select("batch", F.when(F.col("n") == 1, "single").otherwise("each").alias("kind"), F.col("path").alias("input"), F.lit(1).cast("long").alias("files"))
    return whole.unionByName(each)


def with_labels(df: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Each row once per label: one binary model each."""
    return df.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))


def relief_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for a segmentation model: the probability is the visualised value."""
    for b in batches:
        yield b.assign(prob=b["v"])[["r", "c", "label", "prob"]]


def segmentation(pixels: DataFrame, params: RunParameters, res: float, width: int, tile: int = 1024, scale: float = 1.0, scorer: Scorer = relief_scorer) -> DataFrame:
    """Features of one raster by segmentation: label, tr, tc, part, area, roundness.

    pixels (r, c, z) go through relief, the scorer once per label, threshold
    0.5, parts per tile, then roundness and area filters, in that order. A
    scorer is a function over Arrow batches; a model is loaded once per worker.
    """
    if not params.model_labels:
        raise ValueError("no labels")
    if params.vis_exist_ok:
        vis = pixels.withColumn("v", S.unit_clamped(F.col("z")))
    else:
        vis = R.local_relief_tiled(pixels, int(max(10, -(-10 // res))), tile).withColumn("v", S.stretched(F.col("relief") / F.lit(scale)))
    prob = with_labels(vis.select("r", "c", "v"), params.model_labels).mapInPandas(scorer, "r long, c long, label string, prob double")
    keys = ("label",)
    parts = R.components(R.thresholded(prob, "prob"), tile, width, keys)
    f = R.features(parts, res, True, keys).withColumn("roundness", S.roundness(F.col("area"), F.col("hull")))
    return B.at_least(B.at_least(f, "roundness", params.roundness), "area", params.min_area)


def segmentation_of_files(rasters: DataFrame, params: RunParameters, res: float, tile: int = 1024, score: Callable = lambda v, label: v) -> DataFrame:
    """The same straight from raster files of one resolution (path, width, height): one pass per tile, no shuffle.

    `score(values, label)` gives the probabilities of a tile of relief values.
    """
    radius = int(max(10, -(-10 // res)))
    f = R.tile_features(read_tiles(rasters, tile, radius), params.model_labels, score, tile, res, radius)
    f = f.withColumn("roundness", S.roundness(F.col("area"), F.col("hull")))
    return B.at_least(B.at_least(f, "roundness", params.roundness), "area", params.min_area)


def object_detection(records: DataFrame, params: RunParameters) -> DataFrame:
    """Features of box records (file_id, box_no, label, score, pixel box, georeference): label, score, area, bounds.

    Scores are judged first, then boxes of a file are merged, scored, measured
    and held against the least area.
    """
    found = B.confident(B.world_boxes(records))
    labels = records.groupBy("file_id").agg(F.min_by("label", "box_no").alias("label"))
    f = B.part_features(found, "file_id").join(labels, "file_id")
    return B.at_least(f, "area", params.min_area)


def training_patches(rasters: DataFrame, segments: DataFrame, tile_px: int = 512, stagger_px: int = 256, cell: float = 256.0) -> DataFrame:
    """Patch rows of staggered tiles that show a segment: raster_id, bounds, filestem, labeltxt and output paths.

    segments: seg_id, arch_type, dfm, bounds and rings (`polygon.wkt_rings`). No segments: no rows.
    """
    g = G.staggered_grid(rasters, tile_px, stagger_px).join(rasters.select("raster_id", "raster_name", "res"), "raster_id")
    g = g.withColumn("patch", F.concat_ws("-", "raster_id", "tile_id", "copy"))
    g = polygon_semi_join(g, segments, ["patch"], cell)
    lines = P.label_lines(P.relative_bounds(P.shown_segments(g, segments, cell)), "r_arch_type", "r_dfm")
    texts = P.label_texts(lines, "patch", "r_seg_id").filter("labeltxt <> ''")
    stem = S.filestem(F.col("minx"), F.col("miny"))
    out = g.join(texts, "patch").withColumn("filestem", stem)
    for kind, ext, col in (("images", "tif", "images_path"), ("segmentation_masks", "tif", "segmentation_masks_path"), ("labelTxt", "txt", "labeltxt_path")):
        out = out.withColumn(col, S.patch_path(stem, F.col("raster_name"), kind, ext))
    return out.drop("patch")


def duration(seconds: float) -> str:
    return f"{seconds / 60:.1f} min" if seconds >= 60 else f"{seconds:.1f} sec"

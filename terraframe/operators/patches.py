"""Training patches: which segments they show, label texts and masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.geometry import BOUNDS
from terraframe.functions.scalars import truncated
from terraframe.operators.polygon import edges, touched, with_clip
from terraframe.operators.spatial import rect_join
from terraframe.plans import tasks

LEAST_FRACTION = 0.33
MAX_CLASSES = 3
OUT_ROWS, OUT_BYTES = 10_000, 8 << 20  # most rows and bytes of masks that leave a task at once; a mask above it goes alone


def default_quality(dfm: Column) -> Column:
    return F.coalesce(dfm, F.lit(1)).cast("int")


def shown_segments(patches: DataFrame, segments: DataFrame, cell: float, least: float = LEAST_FRACTION) -> DataFrame:
    """(patch, segment) rows where more than `least` of the segment's area lies in the patch: strictly more.

    Both have minx, miny, maxx, maxy; segments also `rings` (see
    `polygon.wkt_rings`). Segments' columns come with the prefix r_; added are
    px0, py0, px1, py1 (bounds of the segment's part in the patch), `fraction`
    and `edge` (1 if the patch cuts the segment). Boxes only choose candidates,
    the polygon itself is clipped. Segments without area have no fraction and
    drop out.
    """
    met = with_clip(rect_join(patches, segments, cell), "r_rings", BOUNDS)
    met = met.withColumn("fraction", F.try_divide("part", "whole")).filter(F.col("fraction") > F.lit(least)).drop("part", "whole")
    return met.withColumn("edge", F.when(F.col("fraction") < 1, 1).otherwise(0))


def relative_bounds(shown: DataFrame, res: str = "res") -> DataFrame:
    """Pixel bounds rx0, ry0, rx1, ry1 of the segment part in the patch, from its top left, and `corners` as text, clockwise from the top left.

    Truncated to whole pixels and held to 0 and the patch width, which bounds both axes.
    """
    r = F.col(res)
    side = truncated((F.col("maxx") - F.col("minx")) / r)
    zero = F.lit(0).cast("long")
    px = {
        "rx0": F.greatest(truncated((F.col("px0") - F.col("minx")) / r), zero), "rx1": F.least(truncated((F.col("px1") - F.col("minx")) / r), side),
        "ry0": F.greatest(truncated((F.col("maxy") - F.col("py1")) / r), zero), "ry1": F.least(truncated((F.col("maxy") - F.col("py0")) / r), side)}
    out = shown.withColumns(px)
    return out.withColumn("corners", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("rx0", "ry0", "rx1", "ry0", "rx1", "ry1", "rx0", "ry1")]))


def label_lines(bounded: DataFrame, label: str, dfm: str) -> DataFrame:
    """`line`: corners, class and quality (1 where missing) of each shown segment."""
    return bounded.withColumn("line", F.concat_ws(" ", "corners", F.col(label), default_quality(F.col(dfm)).cast("string")))


def label_texts(lines: DataFrame, patch: str, order: str) -> DataFrame:
    """patch, labeltxt: the patch's lines in segment order, joined by line breaks. Patches without a line have no row."""
    lines = lines.groupBy(patch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("line")))).alias("a"))
    return lines.select(patch, F.array_join(F.transform("a", lambda v: v["line"]), "\n").alias("labeltxt"))


def pixel_size(patches: DataFrame, res: str = "res") -> DataFrame:
    """Patches that have a resolution, with `n_rows` and `n_cols`: the pixels of their own extent."""
    px = lambda lo, hi: F.ceil(F.round(F.try_divide(F.col(hi) - F.col(lo), F.col(res)), 6)).cast("long")
    return patches.filter(F.col(res) > 0).filter(~F.isnan(res)).withColumns({"n_rows": px("miny", "maxy"), "n_cols": px("minx", "maxx")})


def painted(shown: DataFrame, patch: str, band: str, value: str, order: str, make: Callable[[Iterator[tuple[int, np.ndarray, tuple]]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that `make` gives of a task's masks: it takes each patch with its mask, an array (rows, cols, bands) of bytes, and its minx, maxy and res.

    The segments of a patch stream through its task in order, and rows leave the
    task before their bytes exceed OUT_BYTES, so one mask, one Arrow batch and
    those rows are held however many masks there are.
    """
    rows = pixel_size(shown).select(
        F.col(patch).cast("long").alias("p"), F.col(band).cast("int").alias("band"), F.col(value).cast("int").alias("v"), F.col(order).alias("o"),
        F.col("n_rows"), F.col("n_cols"), "minx", "maxy", "res", "r_rings")
    rows = rows.filter(f"band >= 0 and band < {MAX_CLASSES}").repartition(tasks(rows), "p").sortWithinPartitions("p", "o", "v")

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, tuple]]:
        held, geo, mask = None, (), np.zeros((0, 0, MAX_CLASSES), np.uint8)
        for b in batches:
            e = edges(b.column(9))
            cut = np.searchsorted(e.row, np.arange(b.num_rows + 1)).tolist()
            for k, (p, at, v, _, h, w, minx, maxy, res, _) in enumerate(zip(*[b.column(i).to_pylist() if i < 9 else [None] * b.num_rows for i in range(10)], strict=True)):
                if p != held:
                    if held is not None:
                        yield held, mask, geo
                    held, geo, mask = p, (minx, maxy, res), np.zeros((h, w, MAX_CLASSES), np.uint8)
                i, j = cut[k], cut[k + 1]
                if i < j:
                    r0, c0, hit = touched((e.x1[i:j] - minx) / res, (maxy - e.y1[i:j]) / res, (e.x2[i:j] - minx) / res, (maxy - e.y2[i:j]) / res, h, w)
                    mask[r0:r0 + hit.shape[0], c0:c0 + hit.shape[1], at][hit] = v
        if held is not None:
            yield held, mask, geo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        out, size = [], 0
        for row in make(masks(batches)):
            more = sum(len(x) for x in row if isinstance(x, bytes))
            if out and (len(out) == OUT_ROWS or size + more > OUT_BYTES):
                yield batch(out)
                out, size = [], 0
            out.append(row)
            size += more
        if out:
            yield batch(out)

    return rows.mapInArrow(run, schema).withColumnRenamed("p", patch)


def burn_masks(shown: DataFrame, patch: str = "patch_id", band: str = "band", value: str = "dfm", order: str = "seq") -> DataFrame:
    """Mask of each patch that shows a segment: patch, n_rows, n_cols, minx, maxy, res, mask (rows * cols * 3 bytes, band = class position, background 0).

    shown: rows of `shown_segments` with the columns named. Every pixel whose
    inside a segment's polygon meets gets the segment's value; of several the
    last in `order` wins. The whole segment is burned as far as the patch goes,
    in the patch's own pixels. Patches without a segment or without a
    resolution have no row.
    """
    make = lambda masks: ((p, *m.shape[:2], *g, m.tobytes()) for p, m, g in masks)
    return painted(shown, patch, band, value, order, make, "p long, n_rows long, n_cols long, minx double, maxy double, res double, mask binary")


def mask_sums(shown: DataFrame, patch: str = "patch_id", band: str = "band", value: str = "dfm", order: str = "seq") -> DataFrame:
    """Number and place sums of the pixels of `burn_masks` by patch, band and value: (patch, band, v, n, sum_row, sum_col); no mask leaves its task."""
    def make(masks: Iterator[tuple[int, np.ndarray, tuple]]) -> Iterator[tuple]:
        for p, m, _ in masks:
            r, c, b = np.nonzero(m)
            key = b * 256 + m[r, c, b]
            yield from ((p, k // 256, k % 256, int((hit := key == k).sum()), int(r[hit].sum()), int(c[hit].sum())) for k in np.unique(key).tolist())

    return painted(shown, patch, band, value, order, make, "p long, band int, v int, n long, sum_row long, sum_col long")


def class_bands(classes: list[str]) -> dict[str, int]:
    """Band of each class, from 0 in the order given; one to three classes."""
    if not 1 <= len(classes) <= MAX_CLASSES:
        raise ValueError(f"1 to {MAX_CLASSES} classes, not {len(classes)}")
    return {c: i for i, c in enumerate(classes)}

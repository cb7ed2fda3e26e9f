"""Polygons as rings: parsed by the engine, measured and clipped on whole Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terraframe.functions.geometry import BOUNDS, NUMBER
from terraframe.operators.raster import hull_perimeter
from terraframe.operators.spatial import rect_join

_POINT = re.compile(r"([-+\d.eE]+)\s+([-+\d.eE]+)")
_PAIR = rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*"


def wkt_rings(geometry: Column) -> Column:
    """Rings of a (multi)polygon text as array<struct<outer boolean, x array<double>, y array<double>>>.

    A ring after `((` is an outer one, others are holes. Null, EMPTY, points and
    rings of less than three points give no ring.
    """
    found = F.regexp_extract_all(F.regexp_replace(geometry, r"\s*\(\s*", "("), F.lit(r"\(+[^()]*\)"), F.lit(0))
    axis = lambda s, k: F.transform(F.regexp_extract_all(s, F.lit(_PAIR), F.lit(k)), lambda v: v.cast("double"))
    rings_ = F.transform(found, lambda s: F.struct(s.startswith("((").alias("outer"), axis(s, 1).alias("x"), axis(s, 2).alias("y")))
    return F.coalesce(F.filter(rings_, lambda r: F.size(r["x"]) >= 3), F.array().cast("array<struct<outer:boolean,x:array<double>,y:array<double>>>"))


def rings(wkt: str | None) -> list[np.ndarray]:
    """Rings of a polygon text, each as an array of points; none for null, EMPTY and points."""
    if not wkt or "(" not in wkt:
        return []
    found = (np.array([[float(a), float(b)] for a, b in _POINT.findall(part)]) for part in re.findall(r"\(([^()]*)\)", wkt))
    return [r for r in found if len(r) >= 3]


class Edges(NamedTuple):
    """Edges of the rings of a batch of polygons, in row order: ends, ring and row of each; row and kind of each ring."""

    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    ring: np.ndarray
    row: np.ndarray
    ring_row: np.ndarray
    outer: np.ndarray


def edges(column: pa.Array) -> Edges:
    """Edges of a column of `wkt_rings`, straight from its buffers."""
    count = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    outer, xs, ys = column.flatten().flatten()
    n = xs.value_lengths().to_numpy(zero_copy_only=False)
    x, y = xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)
    end = np.cumsum(n)
    after = np.arange(1, len(x) + 1)
    after[end - 1] = end - n
    ring_row = np.repeat(np.arange(len(count)), count)
    ring = np.repeat(np.arange(len(n)), n)
    return Edges(x, y, x[after], y[after], ring, ring_row[ring], ring_row, outer.to_numpy(zero_copy_only=False).astype(bool))


def _per_row(e: Edges, signed: np.ndarray, rows: int) -> np.ndarray:
    """Areas of rows from signed shares of edges: rings count whole, holes off."""
    ring = np.abs(np.bincount(e.ring, signed, len(e.outer)))
    return np.bincount(e.ring_row, np.where(e.outer, ring, -ring), rows)


def areas(e: Edges, rows: int) -> np.ndarray:
    """Shoelace area of each row's polygons; taken about each ring's first point, to keep digits."""
    first = np.flatnonzero(np.diff(e.ring, prepend=-1))[e.ring]
    ox, oy = e.x1[first], e.y1[first]
    return _per_row(e, ((e.x1 - ox) * (e.y2 - oy) - (e.x2 - ox) * (e.y1 - oy)) / 2, rows)


def areas_within(e: Edges, box: np.ndarray) -> np.ndarray:
    """Area of each row's polygons inside the row's box (minx, miny, maxx, maxy).

    The area under each edge, held to the box in x and y, adds up to it: exact
    for any ring, no clipped ring is built.
    """
    ox, oy = box[e.row, 0], box[e.row, 1]
    w, h = box[e.row, 2] - ox, box[e.row, 3] - oy
    x1, y1, x2, y2 = e.x1 - ox, e.y1 - oy, e.x2 - ox, e.y2 - oy
    a, b = np.clip(x1, 0, w), np.clip(x2, 0, w)
    slope = np.divide(y2 - y1, x2 - x1, out=np.zeros(len(x1)), where=x1 != x2)
    ya, yb = y1 + slope * (a - x1), y1 + slope * (b - x1)
    under = lambda y: np.where(y > h, h * h / 2 + h * (y - h), np.maximum(y, 0) ** 2 / 2)
    plain = ((ya >= 0) & (yb >= 0) & (ya <= h) & (yb <= h)) | (np.abs(yb - ya) < 1e-9)
    mean = np.where(plain, np.clip((ya + yb) / 2, 0, h), np.divide(under(yb) - under(ya), yb - ya, out=np.zeros(len(x1)), where=~plain))
    return _per_row(e, mean * (b - a), len(box))


def bounds_within(e: Edges, box: np.ndarray) -> np.ndarray:
    """Bounds (minx, miny, maxx, maxy) of what lies in the row's box; NaN where nothing does.

    They are those of the edges' parts in the box and of the box corners inside the polygon.
    """
    lo, hi = box[e.row, :2], box[e.row, 2:]
    p, d = np.column_stack([e.x1, e.y1]), np.column_stack([e.x2 - e.x1, e.y2 - e.y1])
    with np.errstate(divide="ignore", invalid="ignore"):
        ta, tb = (lo - p) / d, (hi - p) / d
    still = d == 0
    first = np.where(still, np.where((p >= lo) & (p <= hi), -np.inf, np.inf), np.minimum(ta, tb))
    last = np.where(still, np.inf, np.maximum(ta, tb))
    t0, t1 = np.maximum(first.max(1), 0.0), np.minimum(last.min(1), 1.0)
    met = t0 <= t1
    out = np.full((len(box), 4), np.nan)
    rows = e.row[met]
    for t in (t0, t1):
        q = np.clip(p[met] + d[met] * t[met, None], lo[met], hi[met])
        q = np.where((t[met] == 1.0)[:, None], np.clip(np.column_stack([e.x2, e.y2])[met], lo[met], hi[met]), q)
        np.fmin.at(out[:, :2], rows, q)
        np.fmax.at(out[:, 2:], rows, q)
    for i, j in ((0, 1), (0, 3), (2, 1), (2, 3)):
        cx, cy = box[e.row, i], box[e.row, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            right = ((e.y1 > cy) != (e.y2 > cy)) & (cx < e.x1 + (cy - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1))
        inside = np.bincount(e.row[right], minlength=len(box)) % 2 == 1
        corner = box[inside][:, [i, j]]
        out[inside, :2], out[inside, 2:] = np.fmin(out[inside, :2], corner), np.fmax(out[inside, 2:], corner)
    return out


def with_clip(df: DataFrame, rings_col: str, box: tuple[str, str, str, str]) -> DataFrame:
    """df with whole and part (areas of the polygon and of what lies in the box), and px0, py0, px1, py1, the bounds of that part.

    Null bounds where nothing lies in the box. A polygon inside its box is taken
    whole, so its part equals whole to the last digit. Columns of the new names
    that df already has are replaced.
    """
    new = ("whole", "part", "px0", "py0", "px1", "py1")
    df = df.drop(*new)
    at = df.columns.index(rings_col)
    where = [df.columns.index(c) for c in box]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = edges(b.column(at))
            held = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in where])
            own = np.full((b.num_rows, 4), np.nan)
            xy = np.column_stack([e.x1, e.y1])
            np.fmin.at(own[:, :2], e.row, xy)
            np.fmax.at(own[:, 2:], e.row, xy)
            inside = ((own[:, :2] >= held[:, :2]) & (own[:, 2:] <= held[:, 2:])).all(1)
            whole = areas(e, b.num_rows)
            part = np.where(inside, whole, areas_within(e, held))
            edge = np.where(inside[:, None], own, bounds_within(e, held))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole), pa.array(part), *[pa.array(c, from_pandas=True) for c in edge.T]], schema=to_arrow_schema(out))

    from pyspark.sql import types as T

    out = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in new]])
    return df.mapInArrow(run, out)


def polygon_semi_join(left: DataFrame, polygons: DataFrame, key: list[str], cell: float, mixed: bool = False) -> DataFrame:
    """Rows of `left` (boxes, unique by `key`) that a polygon meets, touching included.

    polygons: bounds and `rings`; what has no ring (a point) counts by its
    bounds. Boxes choose the candidates (see `rect_join` for `mixed`), the edges decide.
    """
    met = rect_join(left.select(*key, *BOUNDS), polygons.select("rings", *BOUNDS), cell, mixed=mixed)
    hit = with_clip(met, "r_rings", BOUNDS).filter("px0 is not null or size(r_rings) = 0")
    return left.join(hit.select(*key).distinct(), key, "left_semi")


def with_measures(df: DataFrame, rings_col: str) -> DataFrame:
    """df with area and hull (the convex hull's perimeter) of each polygon; both null for no polygon."""
    df = df.drop("area", "hull")
    at = df.columns.index(rings_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = edges(b.column(at))
            cut = np.searchsorted(e.row, np.arange(b.num_rows + 1))
            hull = [hull_perimeter(e.x1[i:j], e.y1[i:j]) if j > i else None for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            area = np.where(cut[1:] > cut[:-1], areas(e, b.num_rows), np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(area, from_pandas=True), pa.array(hull, pa.float64())], schema=to_arrow_schema(out))

    from pyspark.sql import types as T

    out = T.StructType([*df.schema.fields, T.StructField("area", T.DoubleType()), T.StructField("hull", T.DoubleType())])
    return df.mapInArrow(run, out)


def touched(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, rows: int, cols: int) -> tuple[int, int, np.ndarray]:
    """First row and column and a boolean array of the pixels that a polygon's edges enclose or cross.

    Edges in pixels from the top left. A pixel counts if its inside shares a
    point with the polygon; what only runs along its border does not count.
    """
    r0, r1 = max(0, int(np.floor(min(y1.min(), y2.min())))), min(rows, int(np.ceil(max(y1.max(), y2.max()))))
    c0, c1 = max(0, int(np.floor(min(x1.min(), x2.min())))), min(cols, int(np.ceil(max(x1.max(), x2.max()))))
    if r0 >= r1 or c0 >= c1:
        return 0, 0, np.zeros((0, 0), bool)
    h, w = r1 - r0, c1 - c0
    flip = np.zeros((h, w + 1), np.int32)  # +1 where a run of pixels begins, -1 after it
    down = y1 > y2
    xa, ya, xb, yb = np.where(down, x2, x1), np.where(down, y2, y1), np.where(down, x1, x2), np.where(down, y1, y2)
    # edges: each row they cross, and the columns in that row
    top, bottom = np.maximum(np.floor(ya), r0).astype(int), np.minimum(np.ceil(yb), r1).astype(int)
    n = np.maximum(bottom - top, 0)
    k = np.repeat(np.arange(len(xa)), n)
    row = top[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(yb > ya, (xb - xa) / (yb - ya), 0.0)[k]
    u = np.where(row <= ya[k], xa[k], xa[k] + (row - ya[k]) * slope)
    v = np.where(row + 1 >= yb[k], xb[k], xa[k] + (row + 1 - ya[k]) * slope)
    lo, hi = np.clip(np.floor(np.minimum(u, v)), c0, c1).astype(int), np.clip(np.ceil(np.maximum(u, v)), c0, c1).astype(int)
    on = hi > lo
    np.add.at(flip, (row[on] - r0, lo[on] - c0), 1)
    np.add.at(flip, (row[on] - r0, hi[on] - c0), -1)
    out = np.cumsum(flip, 1)[:, :w] > 0
    # inside: pixel centres by the crossings to their left
    top, bottom = np.maximum(np.ceil(ya - 0.5), r0).astype(int), np.minimum(np.ceil(yb - 0.5), r1).astype(int)
    n = np.maximum(bottom - top, 0)
    k = np.repeat(np.arange(len(xa)), n)
    row = top[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = xa[k] + (row + 0.5 - ya[k]) * np.where(yb > ya, (xb - xa) / (yb - ya), 0.0)[k]
    odd = np.zeros((h, w + 1), np.int32)
    np.add.at(odd, (row - r0, np.clip(np.ceil(x - 0.5), c0, c1).astype(int) - c0), 1)
    return r0, c0, out | (np.cumsum(odd, 1)[:, :w] % 2 == 1)

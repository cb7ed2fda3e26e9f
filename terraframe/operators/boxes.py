"""Predicted boxes: text form, ground position, merging to features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions.geometry import to_world
from terraframe.functions.labels import least_roots
from terraframe.functions.scalars import half_even, is_confident, score_text
from terraframe.operators.raster import outline
from terraframe.plans import tasks

BOX = ["minx", "miny", "maxx", "maxy"]


def world_boxes(records: DataFrame) -> DataFrame:
    """Pixel boxes (x0, y0, x1, y1, res, x_min, y_max) with ground bounds minx, miny, maxx, maxy added."""
    minx, maxy = to_world(F.col("x_min"), F.col("y_max"), F.col("res"), F.col("x0"), F.col("y0"))
    maxx, miny = to_world(F.col("x_min"), F.col("y_max"), F.col("res"), F.col("x1"), F.col("y1"))
    return records.withColumns({"minx": minx, "miny": miny, "maxx": maxx, "maxy": maxy})


def box_text(boxes: DataFrame) -> DataFrame:
    """Boxes as lines of a box file: rounded pixels (ties to even), label, score with four decimals, georeference."""
    px = [half_even(F.col(c)).cast("string") for c in ("x0", "y0", "x1", "y1")]
    geo = [F.col("epsg").cast("long").cast("string"), *[F.col(c).cast("string") for c in ("res", "x_min", "y_max")]]
    return boxes.withColumn("line", F.concat_ws(" ", *px, "label", score_text(F.col("score")), *geo))


def confident(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    return boxes.filter(is_confident(F.col("score"), least))


def touching(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose boxes of one group touch or overlap; rows sorted by group, then x0."""
    found_a, found_b, a, gap = [], [], np.arange(len(group)), 1
    while True:
        a = a[a + gap < len(group)]
        a = a[(group[a + gap] == group[a]) & (x0[a + gap] <= x1[a])]
        if not len(a):
            break
        b = a + gap
        meet = (y0[b] <= y1[a]) & (y0[a] <= y1[b])
        found_a.append(a[meet])
        found_b.append(b[meet])
        gap += 1
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (a, a)


def _merged(p: pd.DataFrame) -> pd.DataFrame:
    """part and reach of the boxes of whole files, sorted by file, then minx."""
    g = p["g"].to_numpy()
    x0, y0, x1, y1 = (p[c].to_numpy() for c in BOX)
    a, b = touching(g, x0, y0, x1, y1)
    score = p["score"].to_numpy(float)
    reach = score.copy()
    np.fmax.at(reach, a, score[b])
    np.fmax.at(reach, b, score[a])
    w = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b])
    h = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
    joined = w + h > 0
    a, b = a[joined], b[joined]
    no = p["no"].to_numpy()
    rank = np.lexsort((no, g))
    place = np.empty(len(p), int)
    place[rank] = np.arange(len(p))
    root = least_roots(len(p), place[a], place[b])
    return p.assign(part=no[rank[root[place]]], reach=reach)


def _by_file(boxes: DataFrame, group: str, box_no: str, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`make` of the boxes of many whole files at a time: sorted within partitions, so tiny files cost no task or call each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in batches:
            p = p if held is None else pd.concat([held, p], ignore_index=True)
            if not len(p):
                continue
            other = np.flatnonzero((p["g"] != p["g"].iloc[-1]).to_numpy())
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield make(p.iloc[:last].reset_index(drop=True))
            held = p.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield make(held)

    rows = boxes.select(F.col(group).cast("long").alias("g"), F.col(box_no).cast("long").alias("no"), F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in BOX])
    rows = rows.filter("g is not null and no is not null and maxx > minx and maxy > miny").repartition(tasks(rows), "g").sortWithinPartitions("g", "minx")
    return rows.mapInPandas(run, schema)


def parts(boxes: DataFrame, group: str, box_no: str = "box_no") -> DataFrame:
    """Boxes of a file merged to disjoint parts: group, box_no, part, score and the bounds of each box, reach.

    Boxes with a common area or a common edge of some length belong together,
    directly or over others; a shared corner does not join them. part is the
    least box_no of the part. reach is the best score among all boxes of the
    file that touch this box, corners included. Boxes without area are left out.
    """
    out = _by_file(boxes, group, box_no, _merged, "g long, no long, score double, minx double, miny double, maxx double, maxy double, part long, reach double")
    return out.withColumnRenamed("g", group).withColumnRenamed("no", box_no)


def union_of(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges' coordinates in x and y, and which fields between them the boxes cover (row by y)."""
    xs, ys = np.unique(np.concatenate([x0, x1])), np.unique(np.concatenate([y0, y1]))
    step = np.zeros((len(ys), len(xs)), np.int64)
    i, j, k, l = (np.searchsorted(v, w) for v, w in ((ys, y0), (ys, y1), (xs, x0), (xs, x1)))
    for r, c, sign in ((i, k, 1), (i, l, -1), (j, k, -1), (j, l, 1)):
        np.add.at(step, (r, c), sign)
    return xs, ys, step.cumsum(0).cumsum(1)[:-1, :-1] > 0


def union_wkt(xs: np.ndarray, ys: np.ndarray, covered: np.ndarray) -> str:
    """Outline of the covered fields, which hang together, as polygon text; points on straight sides are left out."""
    rings = []
    for ring in outline(*np.nonzero(covered)):
        pts = ring[:-1]
        turn = [p for k, p in enumerate(pts) if (p[0] - pts[k - 1][0]) * (pts[(k + 1) % len(pts)][1] - p[1]) != (p[1] - pts[k - 1][1]) * (pts[(k + 1) % len(pts)][0] - p[0])]
        rings.append("(" + ", ".join(f"{float(xs[x])!r} {float(ys[y])!r}" for x, y in [*turn, turn[0]]) + ")")
    return f"POLYGON ({', '.join(rings)})"


def part_features(boxes: DataFrame, group: str, box_no: str = "box_no", geometry: bool = False) -> DataFrame:
    """One row per part of `parts`: group, part, n_boxes, score (best of all boxes that touch the part), area (overlap counted once), bounds, and on demand its outline.

    Merging, scores and areas are made in one sweep where a file's boxes lie
    sorted: one shuffle in all. The boxes of one file, a tile's detections, are held together.
    """
    def make(p: pd.DataFrame) -> pd.DataFrame:
        m = _merged(p).sort_values(["g", "part"], kind="stable")
        g, part = m["g"].to_numpy(), m["part"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
        x0, y0, x1, y1 = (m[c].to_numpy() for c in BOX)
        n = np.diff(np.append(first, len(m)))
        area = ((x1 - x0) * (y1 - y0))[first]
        shape: list[str | None] = [None] * len(first)
        for k in np.flatnonzero(n > 1) if not geometry else range(len(first)):
            s = slice(first[k], first[k] + n[k])
            xs, ys, covered = union_of(x0[s], y0[s], x1[s], y1[s])
            if n[k] > 1:
                area[k] = np.diff(ys) @ covered @ np.diff(xs)
            if geometry:
                shape[k] = union_wkt(xs, ys, covered)
        return pd.DataFrame({
            "g": g[first], "part": part[first], "n_boxes": n, "score": np.maximum.reduceat(m["reach"].to_numpy(), first), "area": area,
            "minx": np.minimum.reduceat(x0, first), "miny": np.minimum.reduceat(y0, first), "maxx": np.maximum.reduceat(x1, first), "maxy": np.maximum.reduceat(y1, first), "geometry": shape})

    out = _by_file(boxes, group, box_no, make, "g long, part long, n_boxes long, score double, area double, minx double, miny double, maxx double, maxy double, geometry string")
    return (out if geometry else out.drop("geometry")).withColumnRenamed("g", group)


def at_least(features: DataFrame, column: str, limit: float | None) -> DataFrame:
    """Features strictly above the limit; no limit (None or 0) keeps all."""
    return features.filter(F.col(column) > F.lit(limit)) if limit else features

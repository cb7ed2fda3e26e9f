"""Raster operators on pixel relations (r, c, z) and on tiles held as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraframe.functions.labels import least_roots
from terraframe.functions.scalars import as_value, stretched
from terraframe.operators.grid import in_windows


def local_relief(pixels: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Value less the mean of the valid values in the square of 2 radius + 1 around it.

    pixels: keys, r, c, z (integer or double, null for nodata). Two passes of
    range windows, along rows and then along columns, with sums and counts, so
    integers stay exact until the last division. Null in: null out.
    """
    rows = W.partitionBy(*keys, "r").orderBy("c").rangeBetween(-radius, radius)
    cols = W.partitionBy(*keys, "c").orderBy("r").rangeBetween(-radius, radius)
    p = pixels.withColumn("s1", F.sum("z").over(rows)).withColumn("n1", F.count("z").over(rows))
    p = p.withColumn("s", F.sum("s1").over(cols)).withColumn("n", F.sum("n1").over(cols))
    return p.withColumn("relief", F.col("z") - F.try_divide(F.col("s").cast("double"), F.col("n").cast("double"))).drop("s1", "n1", "s", "n")


def box_mean(z: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the valid values around each pixel by an integral image; NaN is nodata."""
    def sums(a: np.ndarray) -> np.ndarray:
        t = np.pad(np.pad(a, radius).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        k = 2 * radius + 1
        return t[k:, k:] - t[:-k, k:] - t[k:, :-k] + t[:-k, :-k]

    ok = ~np.isnan(z)
    n = sums(ok.astype(float))
    return np.divide(sums(np.where(ok, z, 0.0)), n, out=np.full(z.shape, np.nan), where=n > 0)


def local_relief_tiled(pixels: DataFrame, radius: int, tile: int) -> DataFrame:
    """The same as `local_relief`, tile by tile with a halo of the radius; (r, c, relief).

    One shuffle: each tile's window (bounded by tile and radius) goes to one
    task as a dense array. Tiles without a valid pixel are skipped.
    """
    def one(p: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(p["tr"].iloc[0]), int(p["tc"].iloc[0])
        side = tile + 2 * radius
        a = np.full((side, side), np.nan)
        a[p["r"] - tr * tile + radius, p["c"] - tc * tile + radius] = p["z"].astype(float)
        if np.isnan(a).all():
            return pd.DataFrame({"r": [], "c": [], "relief": []})
        d = a - box_mean(a, radius)
        own = p[(p["r"] // tile == tr) & (p["c"] // tile == tc)]
        return pd.DataFrame({"r": own["r"], "c": own["c"], "relief": d[own["r"] - tr * tile + radius, own["c"] - tc * tile + radius]})

    return in_windows(pixels.select("r", "c", F.col("z").cast("double").alias("z")), tile, radius).groupBy("tr", "tc").applyInPandas(one, "r long, c long, relief double")


def valid_pixels(pixels: DataFrame, nodata: str | None = None) -> DataFrame:
    """Pixels with a value: not null, not NaN and not equal to the nodata column (null and NaN nodata included)."""
    return pixels.filter(as_value(F.col("z"), F.col(nodata) if nodata else None).isNotNull())


def thresholded(pixels: DataFrame, column: str, least: float = 0.5) -> DataFrame:
    """Pixels at or above the limit; NaN and null are neither."""
    return pixels.filter(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) >= F.lit(least)))


def visualised(pixels: DataFrame, radius: int, scale: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Relief stretched to [0, 1], nodata 0: the model input, column `v`."""
    p = local_relief(pixels, radius, keys)
    return p.withColumn("v", stretched(F.col("relief") / F.lit(scale))).drop("relief")


def mosaic(pixels: DataFrame, order: str, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """One value per place of overlapping tiles: the tile that comes last in `order` wins; nodata never covers a value."""
    return pixels.filter("z is not null").groupBy(*keys).agg(F.max_by("z", order).alias("z"))


def label_components(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each pixel the position (in the arrays) of its 4-connected part's first pixel by row, then column."""
    n = len(r)
    order = np.lexsort((c, r))
    rr, cc = r[order], c[order]
    across = np.flatnonzero((rr[1:] == rr[:-1]) & (cc[1:] == cc[:-1] + 1))
    width = int(cc.max() - cc.min()) + 2 if n else 1
    flat = (rr - rr.min()) * width + (cc - cc.min()) if n else rr
    down = np.searchsorted(flat, flat + width)
    has = np.flatnonzero((down < n) & (flat[np.minimum(down, n - 1)] == flat + width)) if n else across
    lab = least_roots(n, np.concatenate([across, has]), np.concatenate([across + 1, down[has]]))
    out = np.empty(n, np.int64)
    out[order] = order[lab]
    return out


def components(mask: DataFrame, tile: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """4-connected parts of set pixels (keys, r, c) within each tile of `tile` rows and columns: keys, tr, tc, r, c, part.

    part is the least r * width + c of the part. Parts end at tile borders; a
    tile has at most tile * tile pixels, so a group fits a task by construction.
    """
    def one(p: pd.DataFrame) -> pd.DataFrame:
        r, c = p["r"].to_numpy(), p["c"].to_numpy()
        first = label_components(r, c)
        return p.assign(part=r[first] * width + c[first])

    m = mask.select(*keys, F.floor(F.col("r") / tile).cast("long").alias("tr"), F.floor(F.col("c") / tile).cast("long").alias("tc"), "r", "c")
    out = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in m.schema if f.name in keys], "tr long, tc long, r long, c long, part long"])
    return m.groupBy(*keys, "tr", "tc").applyInPandas(one, out)


def hull_perimeter(x: np.ndarray, y: np.ndarray) -> float:
    """Length of the convex hull's border (monotone chain)."""
    pts = np.unique(np.column_stack([x, y]), axis=0)
    if len(pts) < 2:
        return 0.0

    def half(points: np.ndarray) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    ring = np.array(half(pts)[:-1] + half(pts[::-1])[:-1])
    return float(np.hypot(*(ring - np.roll(ring, -1, 0)).T).sum())


def features(parts: DataFrame, res: float, with_hull: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per part: keys, tr, tc, part, n_pix, area, bounds in pixels and, on demand, the hull's perimeter in ground units.

    Without the hull this is a plain aggregation; hulls need the corners of the
    pixels and run grouped by tile.
    """
    by = [*keys, "tr", "tc", "part"]
    agg = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pix"), (F.count(F.lit(1)) * F.lit(res * res)).alias("area"),
        F.min("c").alias("c0"), F.min("r").alias("r0"), (F.max("c") + 1).alias("c1"), (F.max("r") + 1).alias("r1"))
    if not with_hull:
        return agg

    def hull(p: pd.DataFrame) -> pd.DataFrame:
        r, c, part = (p[n].to_numpy() for n in ("r", "c", "part"))
        hulls = [(part[k[0]], part_hull(r[k], c[k]) * res) for k in _by_part(part)]
        return pd.DataFrame(hulls, columns=["part", "hull"]).assign(**{n: p[n].iloc[0] for n in by[:-1]})[[*by, "hull"]]

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in keys], "tr long, tc long, part long, hull double"])
    hulls = parts.groupBy(*keys, "tr", "tc").applyInPandas(hull, schema)
    return agg.join(hulls, by)


def _by_part(part: np.ndarray) -> list[np.ndarray]:
    """Positions of each part, in the order given."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []


def part_hull(r: np.ndarray, c: np.ndarray) -> float:
    """Perimeter, in pixels, of the hull around the corners of a part's pixels."""
    rows, at = np.unique(r, return_inverse=True)
    lo, hi = np.full(len(rows), c.max() + 1), np.full(len(rows), c.min())
    np.minimum.at(lo, at, c)  # the outer pixels of each row carry the hull
    np.maximum.at(hi, at, c + 1)
    return hull_perimeter(np.concatenate([lo, lo, hi, hi]).astype(float), np.tile(np.concatenate([rows, rows + 1]), 2).astype(float))


TILE_FEATURES = "path string, label string, tr int, tc int, part long, n_pix long, area double, hull double, c0 long, r0 long, c1 long, r1 long"


def relief_tile(values: np.ndarray, radius: int, low: float = -0.5, high: float = 0.5) -> np.ndarray:
    """Stretched relief of a tile read with a halo of `radius`, the halo cut off; nodata 0."""
    d = (values - box_mean(values, radius))[radius:values.shape[0] - radius, radius:values.shape[1] - radius]
    return np.nan_to_num(np.clip((d - low) / (high - low), 0.0, 1.0), nan=0.0)


def tile_features(tiles: DataFrame, labels: tuple[str, ...], score: Callable[[np.ndarray, str], np.ndarray], tile: int, res: float, radius: int, least: float = 0.5) -> DataFrame:
    """Features of raster tiles as `sources.geotiff.read_tiles` reads them with a halo of `radius`, in one pass per tile.

    Relief, score per label, threshold, parts, area and hull are made where the
    tile was read: nothing is shuffled and no pixel becomes a row. Tiles without
    a valid pixel are skipped. `score` gives probabilities for a (rows, cols)
    array and a label; NaN is below every limit. part is row * 2^31 + column of the part's
    first pixel, in pixels of the raster.
    """
    names = [c.split()[0] for c in TILE_FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples(index=False):
                a = np.asarray(t.values, np.float64).reshape(t.rows, t.cols, t.bands)[..., 0]
                if np.isnan(a).all():
                    continue
                v, out = relief_tile(a, radius), []
                for label in labels:
                    r, c = np.nonzero(score(v, label) >= least)
                    first = label_components(r, c)
                    for k in _by_part(first):
                        y, x = r[k] + t.tr * tile, c[k] + t.tc * tile
                        out.append((t.path, label, t.tr, t.tc, (int(y[0]) << 31) + int(x[0]), len(k), len(k) * res * res, part_hull(y, x) * res, x.min(), y.min(), x.max() + 1, y.max() + 1))
                yield pd.DataFrame(out, columns=names)

    return tiles.select("path", "tr", "tc", "rows", "cols", "bands", "values").mapInPandas(run, TILE_FEATURES)


def outline(r: np.ndarray, c: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y in pixel corners) around a 4-connected set of pixels, outer ring and holes."""
    have = set(zip(r.tolist(), c.tolist(), strict=True))
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in have:
        for there, a, b in (((i - 1, j), (j, i), (j + 1, i)), ((i, j + 1), (j + 1, i), (j + 1, i + 1)), ((i + 1, j), (j + 1, i + 1), (j, i + 1)), ((i, j - 1), (j, i + 1), (j, i))):
            if there not in have:
                nxt.setdefault(a, []).append(b)
    rings = []
    while nxt:
        start = at = min(nxt)
        ring, came = [start], (0, 0)
        while True:
            ways = nxt[at]
            # at a corner that two pixels share diagonally, turn right to stay on the same pixel
            k = max(range(len(ways)), key=lambda w: came[0] * (ways[w][1] - at[1]) - came[1] * (ways[w][0] - at[0]))
            to = ways.pop(k)
            if not ways:
                del nxt[at]
            came, at = (to[0] - at[0], to[1] - at[1]), to
            ring.append(at)
            if at == start:
                break
        rings.append(ring)
    return rings


def polygons(parts: DataFrame, x_min: float, y_max: float, res: float) -> DataFrame:
    """WKT outline of each part in ground coordinates (tr, tc, part, geometry), holes as inner rings."""
    def one(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        r, c, part = (p[n].to_numpy() for n in ("r", "c", "part"))
        for k in _by_part(part):
            rings = outline(r[k], c[k])
            text = ", ".join("(" + ", ".join(f"{x_min + x * res!r} {y_max - y * res!r}" for x, y in ring) + ")" for ring in rings)
            out.append((p["tr"].iloc[0], p["tc"].iloc[0], part[k[0]], f"POLYGON ({text})"))
        return pd.DataFrame(out, columns=["tr", "tc", "part", "geometry"])

    return parts.groupBy("tr", "tc").applyInPandas(one, "tr long, tc long, part long, geometry string")
